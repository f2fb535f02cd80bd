"""tagmill run | retry | init"""

from __future__ import annotations

import argparse
import json
import logging
import signal
import sys
from pathlib import Path

from tagmill.config import STARTER, Settings, SettingsError


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tagmill", description="Batch multi-label classification of text tables on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="classify a table")
    run.add_argument("--config", "-c", required=True)
    run.add_argument("--resume", action="store_true", help="go on from the ledger of earlier runs")
    run.add_argument("--fresh", action="store_true", help="with --resume: empty the ledger first")
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--test", type=int, metavar="N", help="the first N items only")
    run.add_argument("--random", type=int, metavar="N", help="N random items only")
    run.add_argument("--concurrency", type=int)
    run.add_argument("--input-csv", metavar="FILE", help="classify this file and compare with its label column")
    again = sub.add_parser("retry", help="retry failed results until nothing more succeeds")
    again.add_argument("source")
    again.add_argument("--config", "-c", help="default: the YAML file beside the source")
    again.add_argument("--max-rounds", type=int, default=3)
    again.add_argument("--dry-run", action="store_true")
    again.add_argument("--concurrency", type=int)
    init = sub.add_parser("init", help="write a starter configuration")
    init.add_argument("--output", default="classify.yaml")
    return top


def beside(source: str) -> str:
    """The only YAML file in the source's folder or one of the two above."""
    for folder in list(Path(source).resolve().parents)[:3]:
        if len(found := sorted(folder.glob("*.y*ml"))) == 1:
            return str(found[0])
    raise SettingsError(["no configuration given and not exactly one YAML file beside the source"])


class Stop:
    """The first interrupt lets the chunk under way finish, the second ends the program."""

    def __init__(self):
        self.asked = False

    def __call__(self) -> bool:
        return self.asked

    def __enter__(self):
        self.before = signal.signal(signal.SIGINT, self._interrupt)
        return self

    def __exit__(self, *_):
        signal.signal(signal.SIGINT, self.before)

    def _interrupt(self, *_):
        if self.asked:
            sys.exit(130)
        self.asked = True


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    if args.command == "init":
        if Path(args.output).exists():
            print(f"{args.output} exists and is left as it is", file=sys.stderr)
            return 1
        Path(args.output).write_text(STARTER, encoding="utf-8")
        return 0
    from tagmill.plans import classify, retry
    from tagmill.session import session
    from tagmill.sources.files import MissingColumns

    try:
        settings = Settings.from_yaml(args.config or beside(args.source))
        if args.concurrency is not None:
            settings.concurrency = args.concurrency
        with Stop() as stop:
            if args.command == "retry":
                made = retry.retry(session(), settings, args.source, max_rounds=args.max_rounds, dry=args.dry_run, stop=stop)
            else:
                made = classify.run(session(), settings, first=args.test, random=args.random, input_csv=args.input_csv, resume=args.resume, fresh=args.fresh, dry=args.dry_run, stop=stop)
    except (SettingsError, MissingColumns, classify.Exclusive, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(made, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
