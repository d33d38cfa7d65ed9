"""A caller's model that fails, is asked once and whose answers are kept."""

import pathlib
import time

from ledgerloom.operators import models


def model(folder, failing=0, never=()):
    """Fails on the first tries of each prompt, and leaves a file a call."""
    folder = pathlib.Path(folder)
    folder.mkdir(exist_ok=True)

    def call(prompt):
        n = len(list(folder.glob(f"{prompt}.*")))
        (folder / f"{prompt}.{n}").write_text(str(time.time()))
        if n < failing or prompt in never:
            raise ConnectionError("busy")
        return f" {prompt.upper()} "

    return call


def calls(folder):
    return sorted(p.name for p in pathlib.Path(folder).iterdir())


def test_tries_again_keeps_and_asks_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "BLOCK", 2)
    rows = [(1, "a", "x", "y"), (2, "b", "x", "y"), (3, "a", "x", "y"), (4, None, "x", "y"), (5, "bad", "x", "y"), (6, "c", "x", "y")]
    df = spark.createDataFrame(rows, "k long, q string, answer string, prompt string")
    path, log = str(tmp_path / "kept"), str(tmp_path / "log")
    got = {r["k"]: (r["answer"], r["error"]) for r in models.answers(df, "q", model(log, 2, ("bad",)), path, tries=3, wait=0).collect()}
    assert got == {1: ("A", None), 2: ("B", None), 3: ("A", None), 4: (None, None), 5: (None, "ConnectionError: busy"), 6: ("C", None)}
    assert calls(log) == sorted(f"{p}.{n}" for p in ("a", "b", "bad", "c") for n in range(3))
    # the next run asks for what failed and what is new only
    log = str(tmp_path / "log2")
    more = df.union(spark.createDataFrame([(7, "d", "", "")], df.schema))
    got = {r["k"]: r["answer"] for r in models.answers(more, "q", model(log), path, wait=0).collect()}
    assert got == {1: "A", 2: "B", 3: "A", 4: None, 5: "BAD", 6: "C", 7: "D"} and calls(log) == ["bad.0", "d.0"]


def test_nothing_to_ask_and_nothing_answered(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, q string")
    assert models.answers(df.where("false"), "q", model(tmp_path / "l"), str(tmp_path / "e")).count() == 0
    for _ in range(2):
        (r,) = models.answers(df, "q", lambda p: None, str(tmp_path / "n"), tries=2, wait=0).collect()
        assert (r["answer"], r["error"]) == (None, "ValueError: no answer")


def test_waits_double_and_rate_is_kept(spark, tmp_path, monkeypatch):
    waits = []
    monkeypatch.setattr(models.time, "sleep", waits.append)

    def failing(prompt):
        raise OSError("down")

    assert models.tried(failing, "a", 5, 5.0) == (None, "OSError: down") and waits == [5, 10, 20, 40]
    monkeypatch.undo()
    df = spark.createDataFrame([(k, f"p{k}") for k in range(12)], "k long, q string")
    models.answers(df, "q", model(tmp_path / "l"), str(tmp_path / "t"), per_second=20, tasks=2).collect()
    at = sorted(float(p.read_text()) for p in (tmp_path / "l").iterdir())
    assert len(at) == 12 and at[-1] - at[0] >= 0.4
