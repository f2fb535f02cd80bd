"""A stop that tasks on any machine see: they ask the driver, at its own address, about once a second."""

from __future__ import annotations

import contextlib
import socket
import threading
from collections.abc import Callable

from pyspark.sql import SparkSession

Address = tuple[str, int]


class StopSignal:
    """While it is entered, answers every connection with 1 if a stop is wanted, else with 0."""

    def __init__(self, spark: SparkSession, stop: Callable[[], bool]):
        conf = spark.sparkContext.getConf()
        self.host, self.stop = conf.get("spark.driver.host", "localhost"), stop
        self.bind = conf.get("spark.driver.bindAddress", self.host)

    def __enter__(self) -> Address:
        self.server, self.over = socket.create_server((self.bind, 0)), threading.Event()
        self.server.settimeout(0.2)
        self.thread = threading.Thread(target=self._serve, daemon=True)
        self.thread.start()
        return self.host, self.server.getsockname()[1]

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()
        self.server.close()

    def _serve(self) -> None:
        while not self.over.is_set():
            with contextlib.suppress(OSError):  # nobody asked in time, or who asked has gone
                line, _ = self.server.accept()
                with line:
                    line.sendall(b"1" if self.stop() else b"0")


class Watch:
    """A task's side: stopped is set soon after a stop is wanted. A driver that can't be reached wants none."""

    def __init__(self, address: Address | None, every: float = 1.0):
        self.address, self.every = address, every
        self.stopped, self.over = threading.Event(), threading.Event()

    def __enter__(self) -> threading.Event:
        if self.address is not None:
            threading.Thread(target=self._ask, daemon=True).start()
        return self.stopped

    def __exit__(self, *_) -> None:
        self.over.set()

    def _ask(self) -> None:
        while not self.over.is_set():
            with contextlib.suppress(OSError), socket.create_connection(self.address, timeout=5) as line:
                if line.recv(1) == b"1":
                    self.stopped.set()
                    return
            self.over.wait(self.every)
