"""Scorers by name: built in, registered, or loaded from a file of the user's own."""

from __future__ import annotations

import importlib.util
import multiprocessing
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Scorer = Callable[..., float | bool | dict]
SCORERS: dict[str, Scorer] = {}


def register_scorer(name: str) -> Callable[[Scorer], Scorer]:
    def add(f: Scorer) -> Scorer:
        if SCORERS.get(name, f) is not f:
            raise ValueError(f"{name} is registered already")
        SCORERS[name] = f
        return f

    return add


def load_object(path: str, name: str):
    """What a Python file calls `name`."""
    spec = importlib.util.spec_from_file_location("tessella_custom", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return getattr(module, name)


def load_scorer(path: str, name: str, **bound) -> Scorer:
    """The function `name` of a Python file, with keyword arguments bound."""
    f = load_object(path, name)
    return partial(f, **bound) if bound else f


def load_sampler(path: str, name: str, **options):
    """A sampler of the user's own: a class of a Python file that offers emit() and update(rho), as Scheduler does."""
    made = load_object(path, name)(**options)
    if not (callable(getattr(made, "emit", None)) and callable(getattr(made, "update", None))):
        raise TypeError(f"{name} lacks emit() or update()")
    return made


def load_dataset(spark: SparkSession, path: str, name: str, **options) -> DataFrame:
    """A dataset of the user's own: a class of a Python file whose frame(spark) gives a DataFrame."""
    df = load_object(path, name)(**options).frame(spark)
    if not isinstance(df, DataFrame):
        raise TypeError(f"{name}.frame() doesn't give a DataFrame")
    return df


def generate_rows(df: DataFrame, path: str, name: str, length: Column, most: int, **options) -> DataFrame:
    """df with the rows that a generator of the user's own makes from it, but for those that are too long: a class of a
    Python file whose generate(df) gives a DataFrame of the same columns."""
    from tessella.operators.batch import append_rows

    return append_rows(df, load_object(path, name)(**options).generate(df).select(*df.columns), length, most)


def score_rows(df: DataFrame, scorer: Scorer | str, text: Column, truth: Column, out: str = "score", failed: float = 0.0, seconds: float | None = None) -> DataFrame:
    """Apply a scorer to each row in Arrow batches. A row that raises scores `failed`; of a dict, `score` is taken.

    With `seconds`, a row that takes longer scores `failed` too: rows are scored in a process of their own, which is
    ended when its row's time is up, so that a scorer that never returns can't hold a task.
    """
    f = SCORERS[scorer] if isinstance(scorer, str) else scorer

    @F.pandas_udf(DoubleType())
    def run(texts: pd.Series, truths: pd.Series) -> pd.Series:
        pairs = list(zip(texts, truths))
        return pd.Series([_guarded(f, a, b, failed) for a, b in pairs] if seconds is None else _timed(f, pairs, failed, seconds), dtype=float)

    return df.withColumn(out, run(text, truth))


def _guarded(f: Scorer, text: str, truth: str, failed: float) -> float:
    try:
        value = f(text, truth)
        return float(value["score"] if isinstance(value, dict) else value)
    except Exception:  # a row must not end the job
        return failed


def _serve(f: Scorer, pairs: list, first: int, failed: float, pipe) -> None:
    for i in range(first, len(pairs)):
        pipe.send(_guarded(f, *pairs[i], failed))
    pipe.close()


def _timed(f: Scorer, pairs: list, failed: float, seconds: float) -> list[float]:
    """Scores of all pairs; a new process takes over after a row whose time was up, or that ended its process."""
    fork, out = multiprocessing.get_context("fork"), []
    while len(out) < len(pairs):
        here, there = fork.Pipe(duplex=False)
        worker = fork.Process(target=_serve, args=(f, pairs, len(out), failed, there))
        worker.start()
        there.close()
        try:
            while len(out) < len(pairs):
                out.append(here.recv() if here.poll(seconds) else None)
                if out[-1] is None:
                    break
        except EOFError:
            out.append(None)
        worker.kill()
        worker.join()
        here.close()
    return [failed if x is None else x for x in out]


def score_batches(df: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], text: Column, truth: Column, out: str = "score") -> DataFrame:
    """Apply a vectorised scorer, which takes and returns whole columns of a batch."""

    @F.pandas_udf(DoubleType())
    def run(texts: pd.Series, truths: pd.Series) -> pd.Series:
        return pd.Series(scorer(texts, truths), dtype=float)

    return df.withColumn(out, run(text, truth))


Manager = Callable[..., DataFrame]
MANAGERS: dict[str, Manager] = {}


def register_manager(name: str) -> Callable[[Manager], Manager]:
    """Register how a table (source, text, truth, length) gets its `score`."""

    def add(f: Manager) -> Manager:
        if MANAGERS.get(name, f) is not f:
            raise ValueError(f"{name} is registered already")
        MANAGERS[name] = f
        return f

    return add


def reward(df: DataFrame, manager: str = "naive", **options) -> DataFrame:
    """Add `score` to rows (source, text, truth, length) by the manager of this name."""
    if manager not in MANAGERS:
        raise ValueError(f"unknown manager {manager}; there are {sorted(MANAGERS)}")
    return MANAGERS[manager](df, **options)


@register_manager("naive")
def _naive(df: DataFrame) -> DataFrame:
    """By data source."""
    from tessella.functions.scoring import score_by_source

    return df.withColumn("score", score_by_source(F.col("source"), F.col("text"), F.col("truth")))


@register_manager("batch")
def _batch(df: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """By a vectorised scorer."""
    return score_batches(df, scorer, F.col("text"), F.col("truth"))


@register_manager("dapo")
def _dapo(df: DataFrame, limit: int, buffer: int, factor: float = 1.0) -> DataFrame:
    """By data source, less the penalty of overlong answers."""
    from tessella.functions.text import overlong_penalty

    return _naive(df).withColumn("score", F.col("score") + overlong_penalty(F.col("length"), limit, buffer, factor))


@register_manager("prime")
def _prime(df: DataFrame, scorer: Scorer | str = "math", seconds: float = 300.0) -> DataFrame:
    """Row by row with a time limit; what fails scores 0."""
    return score_rows(df, scorer, F.col("text"), F.col("truth"), seconds=seconds)


@register_scorer("math")
def _math(text: str, truth: str) -> bool:
    from tessella.functions.scoring import last_boxed, math_equal

    return math_equal(last_boxed(text), truth)
