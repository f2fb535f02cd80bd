import csv
import json

import pytest
from pyspark.sql import functions as F

from tagmill import cli
from tagmill.backends import Call, call, http, replay, rule
from tagmill.config import STARTER, Settings, SettingsError
from tagmill.identity import KEYS
from tagmill.operators.throttle import CycleBudget, Plan, SlidingLimiter
from tagmill.plans import classify, retry
from tagmill.sources import files
from tagmill.sources.ledger import Ledger, drift
from tagmill.streaming.ingest import classify_stream
from tagmill.stopping import StopSignal, Watch

CATS = ["Finance", "Marketing"]


def settings(tmp_path, **more):
    base = dict(categories=CATS, prompt_template="Pick from {categories}", model_name="m", api_base="http://x/v1", output_dir=str(tmp_path / "out"), context_column="context", threshold=90, concurrency=2, base_dir=str(tmp_path))
    return Settings(**base | more)


def write(path, rows, head=("text", "context")):
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        csv.writer(f).writerows([head, *rows])
    return str(path)


def read(path):
    with open(path, newline="", encoding="utf-8-sig") as f:
        return list(csv.DictReader(f))


def answer(name="Finance", conf=95):
    return F.lit(json.dumps({"labels": [{"name": name, "confidence": conf}]}))


def by_text():
    return F.when(F.col("key_text").startswith("bad"), F.lit('{"error": "down"}')).when(F.col("key_text").startswith("odd"), answer("Alchemy")).otherwise(answer())


# ---- settings


def test_settings_from_yaml(tmp_path, monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "second")
    (tmp_path / "p.txt").write_text("From a file: {categories}")
    (tmp_path / "c.yaml").write_text("categories: [A, B, A]\nprompt: {system: inline, system_file: p.txt}\nmodel: {name: m, api_base: u, temperature: 1}\ninput: {file: in.csv, text_column: t}\noutput: {format: CSV}\nrate_limit: {rps: 2.5, window: 2}\nconcurrency: 4\napi_key: never\n")
    s = Settings.from_yaml(tmp_path / "c.yaml")
    assert (s.api_key, s.prompt_template, s.temperature, s.output_format, s.window_requests, s.workers) == ("second", "From a file: {categories}", 1.0, "csv", 5, 4)
    assert s.system_prompt == "From a file: - A\n- B\n- A" and s.category_list == ["A", "B"]
    assert s.input_path == str(tmp_path / "in.csv") and "second" not in repr(s)
    monkeypatch.setenv("LLM_API_KEY", "first")
    assert Settings.from_yaml(tmp_path / "c.yaml").api_key == "first"
    s.validate()
    (tmp_path / "d.yaml").write_text("")
    d = Settings.from_yaml(tmp_path / "d.yaml")
    assert (d.threshold, d.workers, d.tokens_per_call, d.timeout) == (95, 15, 850, 30)


@pytest.mark.parametrize(
    "more, word",
    [
        ({"categories": []}, "categories"),
        ({"model_name": ""}, "model.name"),
        ({"api_base": ""}, "api_base"),
        ({"rate_limit_rps": 1, "rate_limit_window": 0}, "window"),
        ({"rate_limit_rps": 0.5}, "below one request"),
        ({"rate_limit_tps": 100, "tokens_per_call": 850}, "tokens_per_call"),
        ({"cycle_max_calls": 3}, "cycle.duration"),
        ({"cycle_duration": 3}, "cycle.duration"),
        ({"max_retries": 0}, "max_retries"),
        ({"throttle_max_attempts": 0}, "max_attempts"),
        ({"output_format": "pdf"}, "output.format"),
        ({"prompt_template": "no list"}, "{categories}"),
        ({"prompt_template": "{categories} {other}"}, "placeholder"),
        ({"prompt_template": "{categories} {"}, "format"),
        ({"user_prompt_template": "{text} {nope}"}, "placeholder"),
        ({"concurrency": 0}, "concurrency"),
    ],
)
def test_each_problem_is_named(tmp_path, more, word):
    with pytest.raises(SettingsError) as e:
        settings(tmp_path, **more).validate()
    assert word in str(e.value) and len(e.value.problems) == 1


def test_problems_come_together(tmp_path):
    with pytest.raises(SettingsError) as e:
        settings(tmp_path, categories=[], model_name="", max_retries=0).validate()
    assert len(e.value.problems) == 3
    settings(tmp_path, prompt_template="").validate()


def test_plan_shares_the_budget(tmp_path):
    p = Plan.of(settings(tmp_path, rate_limit_rps=7, concurrency=3))
    assert (p.tasks, p.per_task) == (3, 2)
    assert Plan.of(settings(tmp_path, rate_limit_rps=2, concurrency=9)).tasks == 2
    assert Plan.of(settings(tmp_path, rate_limit_tps=2000, tokens_per_call=850)).per_task == 1
    assert Plan.of(settings(tmp_path, cycle_duration=9, cycle_max_calls=5)).chunk == 5
    with pytest.raises(ValueError):
        Plan.of(settings(tmp_path, rate_limit_tps=100, tokens_per_call=850))


# ---- files


def test_formats():
    assert [files.file_format(p) for p in ("a.XLSX", "a.xlsm", "a.xls", "a.xlsb", "a.tsv", "a.csv")] == ["xlsx", "xlsx", "csv", "csv", "csv", "csv"]
    assert files.output_format("auto", "a.xlsx") == "xlsx" and files.output_format("csv", "a.xlsx") == "csv"


def test_csv_round_trip(spark, tmp_path):
    rows = [("007", 'say "hi"'), ("line\nend", ""), ("é,", "NA")]
    df = files.read_table(spark, write(tmp_path / "a.csv", rows), ["text"])
    got = df.orderBy("ord").collect()
    assert [(r["text"], r["context"] or "") for r in got] == rows
    files.write_csv(df, tmp_path / "b.csv", order="ord")
    assert [tuple(r.values()) for r in read(tmp_path / "b.csv")] == rows
    assert files.read_table(spark, tmp_path / "a.csv", na_values=["NA"]).filter("context IS NULL").count() == 2
    with pytest.raises(files.MissingColumns, match="nope"):
        files.read_table(spark, tmp_path / "a.csv", ["nope"])


# ---- ledger


def rows_of(spark, *rows):
    return spark.createDataFrame([(t, "", lab, 90, "", "no", "ok") for t, lab in rows], "key_text string, key_context string, label string, confidence int, confidence_detail string, is_low_confidence string, parse_status string")


def test_ledger_last_wins_and_failures_are_not_successes(spark, tmp_path):
    led = Ledger(spark, tmp_path / "l")
    assert led.results().count() == 0 and led.next_seq() == 1 and led.metadata() is None
    led.append(rows_of(spark, ("a", "Finance"), ("b", "api_error")))
    led.append(rows_of(spark, ("a", "Marketing"), ("b", "unmatched_x")))
    assert {r["key_text"]: r["label"] for r in led.results().collect()} == {"a": "Marketing", "b": "unmatched_x"}
    assert [r["key_text"] for r in led.successes().collect()] == ["a"]
    led.replace(led.successes())
    assert led.results().count() == 1 and led.next_seq() == 3
    led.set_metadata({"threshold": 1, "model": "m"})
    assert drift(led.metadata(), {"threshold": 2, "model": "m", "base_url": "u", "prompt_hash": "h"}) == ["threshold was 1, is 2"]
    led.drop()
    assert led.results().count() == 0


# ---- the call


class Script:
    def __init__(self, *replies):
        self.replies, self.bodies = list(replies), []

    def __call__(self, body):
        self.bodies.append(body)
        r = self.replies.pop(0) if len(self.replies) > 1 else self.replies[0]
        if isinstance(r, Exception):
            raise r
        return r


def ok(content="x", usage=None):
    return 200, json.dumps({"choices": [{"message": {"content": content}}], "usage": usage})


def tried(tmp_path, *replies, **more):
    waits = []
    s = settings(tmp_path, user_prompt_template="{text}/{context}", throttle_base_wait=30, throttle_max_wait=50, throttle_max_attempts=2, **more)
    post = Script(*replies)
    out = call(s, "T", "C", post, SlidingLimiter(0, 1), sleep=waits.append, jitter=lambda a, b: 1.0)
    return out, waits, post


def test_call_states(tmp_path):
    out, waits, post = tried(tmp_path, ok(" y ", {"prompt_tokens": 100, "completion_tokens": 50, "total_tokens": 150}))
    assert (out.raw_response, out.api_success, out.total_tokens, waits) == ("y", True, 150, [])
    assert [m["content"] for m in post.bodies[0]["messages"]] == ["Pick from - Finance\n- Marketing", "T/C"]
    out, waits, _ = tried(tmp_path, (429, ""), (429, ""), ok())
    assert (out.api_success, out.n_429, out.counted_retries, waits) == (True, 2, 0, [30, 50])
    out, waits, _ = tried(tmp_path, (429, ""))
    assert json.loads(out.raw_response)["error"] == "rate_limit_persistent" and out.n_429 == 3
    out, waits, post = tried(tmp_path, (200, '{"choices": []}'))
    assert json.loads(out.raw_response)["error"] == "malformed_api_response" and len(post.bodies) == 1
    out, waits, _ = tried(tmp_path, (500, ""), TimeoutError(), OSError())
    assert (out.n_other_errors, out.n_timeouts, out.n_retries, out.counted_retries, waits) == (2, 1, 2, 3, [4, 8])
    assert json.loads(out.raw_response)["error"] == "api_call_failed_after_3_retries"
    out, waits, _ = tried(tmp_path, (429, ""), (429, ""), (500, ""), (429, ""), (429, ""), ok())
    assert out.api_success and waits == [30, 50, 4, 30, 50]
    out, waits, _ = tried(tmp_path, ok(None), ok())
    assert out.api_success and waits == [4]
    stopped = call(settings(tmp_path), "T", "C", Script(ok()), SlidingLimiter(0, 1), stop=lambda: True)
    assert "cancelled" in stopped.raw_response


def test_http_backend_calls_once_per_item(spark, tmp_path):
    s = settings(tmp_path, jitter_seconds=0, concurrency=4)

    def fake(_):
        return lambda body: (200, json.dumps({"choices": [{"message": {"content": json.dumps({"labels": [{"name": "Finance", "confidence": len(body["messages"][1]["content"])}]})}}], "usage": {"total_tokens": 7}}))

    items = spark.createDataFrame([(f"t{i}", "", i) for i in range(120)], "key_text string, key_context string, ord long")
    got = classify.classify(items, http(s, post=fake), s)
    got.write.parquet(str(tmp_path / "got"))
    rows = spark.read.parquet(str(tmp_path / "got")).collect()
    assert len(rows) == 120 and {r["label"] for r in rows} == {"Finance"} and {r["tokens_used"] for r in rows} == {7}


def test_replay_answers_what_it_lacks_with_an_error(spark, tmp_path):
    items = spark.createDataFrame([("a", "", 1), ("b", "", 2)], "key_text string, key_context string, ord long")
    known = spark.createDataFrame([("a", "", '{"labels": [{"name": "Finance", "confidence": 99}]}')], "key_text string, key_context string, raw_response string")
    got = {r["key_text"]: r["label"] for r in classify.classify(items, replay(known), settings(tmp_path)).collect()}
    assert got == {"a": "Finance", "b": "api_error"}
    assert Call().failed("x").raw_response == '{"error": "x"}'


# ---- runs


def test_full_run(spark, tmp_path):
    source = write(tmp_path / "in.csv", [("Same", "A"), ("Same", "A"), ("Same", "B"), ("odd", "C"), ("bad", ""), ("", "")])
    s = settings(tmp_path, input_file="in.csv")
    made = classify.run(spark, s, rule(by_text()))
    got = {(r["text"], r["context"]): (r["label"], r["is_low_confidence"]) for r in read(made["csv"])}
    assert got == {("Same", "A"): ("Finance", "no"), ("Same", "B"): ("Finance", "no"), ("odd", "C"): ("unclassified", "yes"), ("bad", ""): ("api_error", "yes"), ("", ""): ("Finance", "no")}
    assert [r["text"] for r in read(made["csv"])] == ["Same", "Same", "odd", "bad", ""]
    assert [r["raw_label"] for r in read(made["audit"])] == ["unmatched_Alchemy"]
    from pathlib import Path

    folder = Path(made["folder"])
    assert "| Unique items (deduplicated) | 5 |" in (folder / "classification_report.md").read_text()
    figures = json.loads((folder / "run_summary.json").read_text())
    assert (figures["total"], figures["success"], figures["failed"]) == (5, 3, 2)
    assert len(read(folder / "unique_items.csv")) == 5 and folder.name.endswith("_full")
    plan = classify.run(spark, s, dry=True)
    assert plan["items"] == 5 and plan["estimated_tokens"] == 5 * 850
    assert source.endswith("in.csv")


def test_resume_then_run_is_run(spark, tmp_path):
    write(tmp_path / "in.csv", [(f"{'bad' if i % 5 == 0 else 'ok'}{i}", "") for i in range(20)])
    s = settings(tmp_path, input_file="in.csv")
    classify.run(spark, s, rule(by_text()), first=10, resume=True)
    assert classify.run(spark, s, dry=True, resume=True) | {"plan": ""} == {"items": 20, "estimated_tokens": 17000, "plan": "", "existing": 8, "remaining": 12}
    # successes aren't called again
    again = classify.run(spark, s, rule(answer("Marketing")), resume=True)
    labels = {r["text"]: r["label"] for r in read(again["csv"])}
    assert len(labels) == 20 and {labels[f"ok{i}"] for i in range(1, 5)} == {"Finance"} and labels["bad0"] == labels["ok19"] == "Marketing"
    assert len(read(tmp_path / "out" / "classification_result_accumulated.csv")) == 20
    # history of items that are no longer in the input stays
    write(tmp_path / "in.csv", [("new", "")])
    classify.run(spark, s, rule(by_text()), resume=True)
    assert len(read(tmp_path / "out" / "classification_result_accumulated.csv")) == 21
    classify.run(spark, s, rule(by_text()), resume=True, fresh=True)
    assert len(read(tmp_path / "out" / "classification_result_accumulated.csv")) == 1


def test_stop_between_chunks_loses_nothing(spark, tmp_path):
    s = settings(tmp_path)
    items = spark.createDataFrame([(f"t{i}", "", i) for i in range(40)], "key_text string, key_context string, ord long")
    led = Ledger(spark, tmp_path / "l")
    plan = Plan(2, 0, 1.0, 10, 0, 0)
    asked = iter([False, False, True])
    done = classify.commit_in_chunks(items, rule(by_text()), s, led, plan, stop=lambda: next(asked))
    assert 0 < done < 40 and led.results().count() == done
    from tagmill.operators.merge import resume_todo

    classify.commit_in_chunks(resume_todo(items, led.successes()), rule(by_text()), s, led, plan)
    assert led.read().count() == 40 == led.results().count()


def test_stopped_run_reports_what_it_did_not_call(spark, tmp_path):
    write(tmp_path / "in.csv", [("a", ""), ("b", "")])
    made = classify.run(spark, settings(tmp_path, input_file="in.csv"), rule(by_text()), resume=True, stop=lambda: True)
    assert {(r["label"], r["parse_status"]) for r in read(made["csv"])} == {("processing_error", "cancelled")}
    assert Ledger(spark, tmp_path / "out" / "ledger").read().count() == 0
    from pathlib import Path

    assert "stopped between chunks" in (Path(made["folder"]) / "run.log").read_text()


def test_stop_reaches_tasks_within_a_chunk(spark, tmp_path):
    """Calls under way are committed, no other is made, and what a stop cancelled is called when resuming."""
    s = settings(tmp_path, concurrency=2, jitter_seconds=0)
    items = spark.createDataFrame([(f"t{i}", "", i) for i in range(200)], "key_text string, key_context string, ord long")
    led = Ledger(spark, tmp_path / "l")
    plan, made = Plan(2, 0, 1.0, 1000, 0, 0), tmp_path / "calls"
    made.mkdir()
    where = str(made)

    def slow(_):
        def post(body):
            import os
            import time
            import uuid

            open(os.path.join(where, uuid.uuid4().hex), "w").close()
            time.sleep(0.3)
            return 200, '{"choices": [{"message": {"content": "{\\"labels\\": [{\\"name\\": \\"Finance\\", \\"confidence\\": 99}]}"}}]}'

        return post

    stop = lambda: len(list(made.iterdir())) >= 6
    with StopSignal(spark, stop) as signal:
        done = classify.commit_in_chunks(items, http(s, plan, slow, signal), s, led, plan, stop=stop)
    calls = len(list(made.iterdir()))
    assert 6 <= calls < 60 and done == calls == led.read().count()
    assert {r["label"] for r in led.read().select("label").distinct().collect()} == {"Finance"}
    rest = classify.cancelled(items, led.results())
    assert rest.count() == 200 - done and {r[0] for r in rest.select("parse_status").distinct().collect()} == {"cancelled"}


def test_a_driver_that_cannot_be_reached_stops_nothing():
    with Watch(("localhost", 1), every=0.01) as stopped:
        assert not stopped.wait(0.1)


def test_cycle_budget_splits_chunks(spark, tmp_path):
    now = [0.0]
    s = settings(tmp_path, cycle_duration=10, cycle_max_calls=3)
    items = spark.createDataFrame([(f"{'bad' if i == 0 else 'ok'}{i}", "", i) for i in range(7)], "key_text string, key_context string, ord long")
    led = Ledger(spark, tmp_path / "l")
    waits = []

    def sleep(x):
        waits.append(x)
        now[0] += x

    budget = CycleBudget(10, 3, clock=lambda: now[0])
    assert classify.commit_in_chunks(items, rule(by_text()), s, led, Plan.of(s), budget, sleep=sleep) == 7
    # six successes fill two cycles; the failure freed its place, but may come after them
    assert len(waits) in (1, 2) and led.results().count() == 7


def test_compare_run(spark, tmp_path):
    source = write(tmp_path / "old.csv", [("a", "", "Finance"), ("a", "", "Marketing"), ("b", "", "Marketing"), ("c", "", "")], ("text", "context", "label"))
    made = classify.run(spark, settings(tmp_path), rule(by_text()), input_csv=source)
    got = {r["text"]: (r["compare_old_label"], r["compare_is_match"]) for r in read(made["csv"])}
    assert got == {"a": ("Finance", "yes"), "b": ("Marketing", "no"), "c": ("", "no")}
    assert [r["text"] for r in read(made["diff"])] == ["b", "c"]
    for more in ({"first": 1}, {"random": 1}, {"resume": True}):
        with pytest.raises(classify.Exclusive):
            classify.run(spark, settings(tmp_path), rule(by_text()), input_csv=source, **more)


HEAD = ("text", "context", "label", "confidence", "confidence_detail", "is_low_confidence", "parse_status", "tokens_used")


def test_retry_to_convergence(spark, tmp_path):
    rows = [("good", "", "Finance"), ("bad1", "", "api_error"), ("odd1", "", "unclassified"), ("late", "", "parse_error"), ("late", "", "parse_error"), ("short", "", "")]
    source = write(tmp_path / "r.csv", [(*r, 0, "{}", "yes", "x", "") for r in rows], HEAD)
    s = settings(tmp_path)
    assert retry.retry(spark, s, source, dry=True) == {"failures": 5, "breakdown": {"api_error": 1, "unclassified": 1, "parse_error": 2, "other": 1}}
    made = retry.retry(spark, s, source, rule(by_text()), max_rounds=5)
    # late and short recover in the first round, nothing in the second
    assert [r["recovered"] for r in made["rounds"]] == [2, 0] and made["failures"] == 2
    got = [(r["text"], r["label"]) for r in read(source)]
    assert got[0] == ("good", "Finance") and {t for t, _ in got} == {"good", "bad1", "odd1", "late", "short"}
    assert dict(got)["bad1"] == "api_error" and dict(got)["odd1"] == "unclassified"


def test_items_that_fail_twice_are_given_up(spark, tmp_path):
    source = write(tmp_path / "r.csv", [("odd1", "", "unclassified", 0, "{}", "yes", "x", ""), *((f"n{i}", "", "api_error", 0, "", "yes", "x", "") for i in range(3))], HEAD)
    # in each round one more of the others recovers
    state = {"round": 0}

    def backend(items):
        state["round"] += 1
        raw = F.when(F.col("key_text") == "odd1", answer("Alchemy")).when(F.col("key_text") <= f"n{state['round'] - 1}", answer()).otherwise(F.lit('{"error": "x"}'))
        from tagmill.backends import answered

        return answered(items, raw)

    made = retry.retry(spark, settings(tmp_path), source, backend, max_rounds=3)
    assert [r["recovered"] for r in made["rounds"]] == [1, 1, 1] and made["exhausted"] == 1


def test_streaming_is_exactly_once(spark, tmp_path):
    s = settings(tmp_path)
    folder = tmp_path / "stream"
    spark.createDataFrame([("a", ""), ("a", ""), ("b", "")], "text string, context string").coalesce(1).write.parquet(str(folder))
    led = Ledger(spark, tmp_path / "l")

    def go():
        stream = spark.readStream.schema("text string, context string").parquet(str(folder))
        classify_stream(stream, rule(by_text()), s, led, str(tmp_path / "cp")).awaitTermination()

    go()
    assert led.read().count() == 2
    spark.createDataFrame([("b", ""), ("c", "")], "text string, context string").coalesce(1).write.mode("append").parquet(str(folder))
    go()
    assert sorted(r["key_text"] for r in led.read().collect()) == ["a", "b", "c"]
    assert led.results().select(*KEYS).distinct().count() == 3


# ---- command line


def test_init_refuses_to_overwrite(tmp_path, capsys):
    target = tmp_path / "c.yaml"
    assert cli.main(["init", "--output", str(target)]) == 0 and target.read_text() == STARTER
    assert cli.main(["init", "--output", str(target)]) == 1
    Settings.from_yaml(target).validate()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("tagmill.session.session", lambda *a, **k: spark)
    write(tmp_path / "in.csv", [("a", ""), ("b", "")])
    (tmp_path / "c.yaml").write_text(f"categories: [Finance]\nmodel: {{name: m, api_base: u}}\ninput: {{file: in.csv}}\noutput: {{dir: {tmp_path}/out}}\n")
    assert cli.main(["run", "-c", str(tmp_path / "c.yaml"), "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["items"] == 2
    source = write(tmp_path / "r.csv", [("x", "unclassified")], ("text", "label"))
    assert cli.main(["retry", source, "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["failures"] == 1
    assert cli.main(["run", "-c", str(tmp_path / "c.yaml"), "--input-csv", source, "--test", "1"]) == 1
    (tmp_path / "d.yaml").write_text("categories: []\n")
    assert cli.main(["run", "-c", str(tmp_path / "d.yaml")]) == 1


# ---- crashes and replays


def test_a_crash_while_the_pointer_is_written_loses_nothing(spark, tmp_path, monkeypatch):
    led = Ledger(spark, tmp_path / "l")
    led.append(rows_of(spark, ("a", "Finance"), ("b", "api_error")))
    led.replace(led.results())
    real = Ledger._fs

    def stopping(self, path):
        where, fs = real(self, path)
        if path.endswith("current.json.2"):
            raise KeyboardInterrupt
        return where, fs

    monkeypatch.setattr(Ledger, "_fs", stopping)
    with pytest.raises(KeyboardInterrupt):  # the new pointer is whole beside, not yet in place
        led.replace(led.successes())
    monkeypatch.setattr(Ledger, "_fs", real)
    assert {r["key_text"] for r in Ledger(spark, tmp_path / "l").results().collect()} == {"a", "b"}
    led.replace(led.successes())
    assert [r["key_text"] for r in Ledger(spark, tmp_path / "l").results().collect()] == ["a"]


def test_a_batch_that_runs_again_calls_nothing(spark, tmp_path):
    from tagmill.streaming.ingest import batch_of

    calls = []

    def backend(items):
        calls.append(items.count())
        return rule(by_text())(items)

    s, led = settings(tmp_path), Ledger(spark, tmp_path / "l")
    frame = spark.createDataFrame([("good", "x"), ("bad", "x")], "text string, context string")
    for number in (0, 0, 1, 1):
        batch_of(frame, number, backend, s, led)
    assert calls == [2, 1] and led.read().count() == 3  # the second batch tries the failed item once


def test_chunks_keep_the_windows_budget(spark, tmp_path):
    s = settings(tmp_path, rate_limit_rps=1, rate_limit_window=20)
    plan = Plan(1, 20, 20.0, 2, 0.0, 0)
    items = spark.createDataFrame([(f"t{i}", "", i) for i in range(12)], "key_text string, key_context string, ord long")
    waits = []
    assert classify.commit_in_chunks(items, rule(by_text()), s, Ledger(spark, tmp_path / "l"), plan, sleep=waits.append) == 12
    assert len(waits) == 5 and all(15 < w <= 20 for w in waits)
    free = []
    classify.commit_in_chunks(items, rule(by_text()), s, Ledger(spark, tmp_path / "m"), Plan(1, 0, 20.0, 4, 0.0, 0), sleep=free.append)
    assert not free


def test_windows_of_one_limiter_are_many_partitions(spark):
    from tagmill.operators.throttle import sliding_window

    rows = [(i, t) for i, t in enumerate([0, 5, 10, 10, 15, 19, 20, 25, 40, 60])]
    df = spark.createDataFrame(rows, "i int, t long").select("i", F.timestamp_seconds("t").alias("ts"), F.lit(2).alias("w"), F.lit("x").alias("_own"))
    got = {r["i"]: (r["n_window"], r["tokens_window"]) for r in sliding_window(df, "ts", 10, tokens="w").collect()}
    expected = {i: sum(t - 10 < u <= t for _, u in rows) for i, t in rows}
    assert got == {i: (n, 2 * n) for i, n in expected.items()}
