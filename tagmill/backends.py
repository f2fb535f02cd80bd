"""Where answers come from. A backend takes items (keys and ord) and returns them with the columns of ANSWER_FIELDS.

replay   joins recorded responses
rule     computes responses with a Column expression
http     posts to an OpenAI-compatible endpoint, in threads of mapInPandas tasks
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.config import Settings
from tagmill.identity import KEYS
from tagmill.operators.throttle import Plan, SlidingLimiter
from tagmill.schemas import ANSWER_FIELDS
from tagmill.stopping import Address, Watch

Backend = Callable[[DataFrame], DataFrame]

CANCELLED = "cancelled (graceful shutdown)"


def answered(items: DataFrame, raw: Column, **given: Column) -> DataFrame:
    """items with raw_response and the other answer columns, absent ones empty."""
    none = {"api_success": F.lit(True), "backoff_seconds": F.lit(0.0)}
    counts = {"n_retries", "n_429", "n_timeouts", "n_other_errors", "counted_retries"}
    made = {"raw_response": raw}
    for name, kind in ANSWER_FIELDS[1:]:
        made[name] = given.get(name, none.get(name, F.lit(0) if name in counts else F.lit(None))).cast(kind)
    return items.withColumns(made)


def replay(responses: DataFrame) -> Backend:
    """responses: keys and raw_response, optionally other answer columns. Items without one answer as an error."""

    def run(items: DataFrame) -> DataFrame:
        known = responses.select(*KEYS, *(F.col(n).alias(f"_{n}") for n, _ in ANSWER_FIELDS if n in responses.columns))
        both = items.join(known, KEYS, "left")
        given = {n: F.col(f"_{n}") for n, _ in ANSWER_FIELDS[1:] if n in responses.columns}
        raw = F.coalesce("_raw_response", F.lit('{"error": "no recorded response"}'))
        return answered(both, raw, **given).drop(*(f"_{n}" for n, _ in ANSWER_FIELDS))

    return run


def rule(raw: Column) -> Backend:
    return lambda items: answered(items, raw)


@dataclass
class Call:
    """One item's answer and what it took."""

    raw_response: str = ""
    api_success: bool = False
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    total_tokens: int | None = None
    n_retries: int = 0
    n_429: int = 0
    n_timeouts: int = 0
    n_other_errors: int = 0
    counted_retries: int = 0
    backoff_seconds: float = 0.0

    def failed(self, error: str, **more) -> Call:
        self.raw_response = json.dumps({"error": error, **more}, ensure_ascii=False)
        return self


Reply = tuple[int, str]
Post = Callable[[dict], Reply]


def poster(settings: Settings) -> Post:
    """Posts a body; returns status and text. Raises TimeoutError, or OSError for what has no status."""
    url = settings.api_base.rstrip("/") + "/chat/completions"
    head = {"Content-Type": "application/json", "Authorization": f"Bearer {settings.api_key}"}

    def post(body: dict) -> Reply:
        request = urllib.request.Request(url, json.dumps(body).encode(), head)
        try:
            with urllib.request.urlopen(request, timeout=settings.timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise TimeoutError from e
            raise

    return post


def call(settings: Settings, text: str, context: str, post: Post, limiter: SlidingLimiter, sleep=time.sleep, jitter=random.uniform, stop=lambda: False) -> Call:
    """Tries until there is an answer or a budget is used up.

    A 429 doesn't use up attempts: it waits linearly longer with each in a row and has a budget of its own. Everything else
    that fails uses an attempt and waits twice as long each time. A well-formed status without a message isn't tried again."""
    out = Call()
    body = {
        "model": settings.model_name,
        "messages": [{"role": "system", "content": settings.system_prompt}, {"role": "user", "content": settings.user_prompt_template.format(text=text, context=context)}],
        "temperature": settings.temperature,
        "max_tokens": settings.max_tokens,
    }
    attempt = limited = 0
    while attempt < settings.max_retries:
        if stop() or not limiter.acquire(stop):
            return out.failed(CANCELLED)
        try:
            status, answer = post(body)
            if status == 429:
                out.n_429 += 1
                limited += 1
                out.n_retries += 1
                if limited > settings.throttle_max_attempts:
                    return out.failed("rate_limit_persistent", attempts=limited)
                wait = min(settings.throttle_base_wait * limited, settings.throttle_max_wait) * jitter(0.5, 1.5)
                out.backoff_seconds += wait
                sleep(wait)
                continue
            limited = 0
            if status == 200:
                data = json.loads(answer)
                try:
                    content = data["choices"][0]["message"]["content"]
                except (KeyError, IndexError, TypeError):
                    out.n_other_errors += 1
                    return out.failed("malformed_api_response", body=answer[:200])
                out.raw_response = content.strip()  # no text at all: an exception like any other
                out.api_success = True
                usage = data.get("usage") or {}
                out.prompt_tokens, out.completion_tokens, out.total_tokens = (usage.get(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens"))
                return out
            out.n_other_errors += 1
        except TimeoutError:
            limited = 0
            out.n_timeouts += 1
            out.n_retries += 1
        except Exception:  # whatever it is, the item's budget decides
            limited = 0
            out.n_other_errors += 1
            out.n_retries += 1
        attempt += 1
        out.counted_retries += 1
        if attempt < settings.max_retries:
            wait = 2.0 ** (attempt + 1)
            out.backoff_seconds += wait
            sleep(wait)
    return out.failed(f"api_call_failed_after_{settings.max_retries}_retries")


def called(items: DataFrame) -> DataFrame:
    """Answers but those of items that a stop kept from being called."""
    return items.filter(~F.col("raw_response").eqNullSafe(F.lit(Call().failed(CANCELLED).raw_response)))


def http(settings: Settings, plan: Plan | None = None, post: Callable[[Settings], Post] = poster, signal: Address | None = None) -> Backend:
    """The plan's tasks share the window's budget in equal parts. Run it with spark.speculation off and write its output
    before anything reads it twice: every evaluation is a call. signal: where tasks ask whether to stop (StopSignal); calls
    under way then end, and the other items come back as cancelled."""
    plan = plan or Plan.of(settings)
    threads = max(1, settings.workers // plan.tasks)

    def run(items: DataFrame) -> DataFrame:
        if items.sparkSession.sparkContext.getConf().get("spark.speculation", "false") == "true":
            raise ValueError("with spark.speculation a slow task would make its calls twice; switch it off")
        names = list(items.columns)
        schema = ", ".join([f"`{n}` {t}" for n, t in items.dtypes] + [f"{n} {t}" for n, t in ANSWER_FIELDS])

        def tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            send, limiter = post(settings), SlidingLimiter(plan.per_task, plan.seconds)

            def one(pair: tuple[str, str]) -> Call:
                if settings.jitter_seconds > 0:
                    stopped.wait(random.uniform(0, settings.jitter_seconds))
                return call(settings, *pair, send, limiter, sleep=stopped.wait, stop=stopped.is_set)

            with Watch(signal) as stopped, ThreadPoolExecutor(threads) as pool:
                for frame in frames:
                    done = list(pool.map(one, zip(frame["key_text"], frame["key_context"], strict=True)))
                    made = pd.DataFrame([asdict(x) for x in done], columns=[n for n, _ in ANSWER_FIELDS])
                    for n, kind in ANSWER_FIELDS:
                        if kind == "bigint":
                            made[n] = made[n].astype("Int64")
                    yield pd.concat([frame.reset_index(drop=True), made], axis=1)[names + [n for n, _ in ANSWER_FIELDS]]

        return items.repartition(plan.tasks).mapInPandas(tasks, schema)

    return run
