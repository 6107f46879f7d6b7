"""Model backends and the operators that call them, a client a partition."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.batches import slices
from leafmill.functions import text


class Backend(Protocol):
    """What answers a question from a context, judges two answers, and finds supporting sentences."""

    def answer(self, question: str, context: str) -> str: ...

    def equivalent(self, a: str, b: str) -> bool: ...

    def evidence(self, question: str, answer: str, sentences: list[str]) -> list[int]: ...


def _plain(s: str) -> str:
    return re.sub(r"[ \n\t\r]+", " ", s).strip(" ").lower()


class Containment:
    """Offline and deterministic: the question is the passage looked for, and the answer itself where the context holds it."""

    def answer(self, question: str, context: str) -> str:
        return question if question and question in context else ""

    def equivalent(self, a: str, b: str) -> bool:
        return _plain(a) == _plain(b)

    def evidence(self, question: str, answer: str, sentences: list[str]) -> list[int]:
        return [i for i, s in enumerate(sentences, 1) if answer in s or s in answer]


class Prompted:
    """A text-in, text-out model behind the three calls."""

    def __init__(self, complete: Callable[[str], str]):
        self.complete = complete

    def answer(self, question: str, context: str) -> str:
        return self.complete(f"Answer the question from the context only, in few words; say nothing if it isn't there.\nQuestion: {question}\nContext: {context}") or ""

    def equivalent(self, a: str, b: str) -> bool:
        try:
            return self.complete(f"Do these two answers mean the same? Say YES or NO.\n1: {a}\n2: {b}").strip().upper() == "YES"
        except Exception:  # noqa: BLE001 - a failed judgement counts as no
            return False

    def evidence(self, question: str, answer: str, sentences: list[str]) -> list[int]:
        lines = "\n".join(f"{i}: {s}" for i, s in enumerate(sentences, 1))
        reply = self.complete(f"Which sentences support the answer? Give their numbers only.\nQuestion: {question}\nAnswer: {answer}\n{lines}")
        return [int(x) for x in re.findall(r"\d+", reply or "")]


_BACKENDS: dict[str, Callable[[], Backend]] = {"containment": Containment}


def register(name: str, make: Callable[[], Backend]) -> None:
    """Name a backend; `make` runs once a partition on the executors."""
    _BACKENDS[name] = make


def backend(name: str) -> Callable[[], Backend]:
    if name not in _BACKENDS:
        raise KeyError(f"no model backend {name!r}; there are {sorted(_BACKENDS)}")
    return _BACKENDS[name]


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def _mapped(df: DataFrame, columns: list[str], when: Column, out: str, kind: str, call: Callable[[Backend, tuple], object], make: Callable[[], Backend]) -> DataFrame:
    """df with the model's output for some columns, null where `when` doesn't hold.

    Distinct inputs are found by an aggregation, which combines repeated ones before they
    are shuffled, and go through the model once each.  Their outputs come back by a join on
    two 64-bit hashes of the input, so the inputs themselves move once, and rows that
    aren't asked spread by all their columns.
    """
    parts = [F.coalesce(F.to_json(F.col(c)) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c), F.lit("\0")) for c in columns]
    keyed = df.withColumn("_when", F.coalesce(when, F.lit(False)))
    simple = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType))]
    keyed = keyed.withColumn("_key", F.when(F.col("_when"), F.xxhash64(*parts)).otherwise(F.xxhash64(F.lit(0), *simple))).withColumn("_check", F.when(F.col("_when"), F.xxhash64(F.lit(1), *parts)))
    kind_of = T.StructType.fromDDL(f"x {kind}")[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in slices(batches):
            got = [call(own, row) for row in zip(*(batch.column(c).to_pylist() for c in columns))]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_check"), pa.array(got, _ARROW[kind])], ["_key", "_check", out])

    inputs = keyed.where("_when").select("_key", "_check", *columns).distinct()
    given = inputs.mapInArrow(run, T.StructType([T.StructField("_key", T.LongType()), T.StructField("_check", T.LongType()), T.StructField(out, kind_of)]))
    return keyed.join(given, ["_key", "_check"], "left").select(*(F.col(f"`{c}`") for c in df.columns), out)


def ask(df: DataFrame, question: str = "question", context: str = "context", out: str = "llm_answer", model: str = "containment") -> DataFrame:
    """df with the model's answer; blank contexts aren't sent and answer null."""
    return _mapped(df, [question, context], ~text.is_blank(F.col(context)), out, "string", lambda m, r: m.answer(r[0] or "", r[1]) if r[1].strip() else None, backend(model))


def judged(df: DataFrame, a: str, b: str, out: str = "is_equivalent", model: str = "containment") -> DataFrame:
    """df with whether the model takes two answers as equivalent; nulls aren't."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return _mapped(df, [a, b], both, out, "boolean", lambda m, r: bool(m.equivalent(*r)), backend(model)).withColumn(out, F.coalesce(out, F.lit(False)))


def supported(df: DataFrame, question: str, answer: str, context: str, out: str = "node_summary", model: str = "containment") -> DataFrame:
    """df with the sentences of context that support the answer, in their order; empty for none or a failure."""

    def call(m: Backend, row: tuple) -> list[int]:
        try:
            return list(m.evidence(row[0] or "", row[1] or "", row[2]))
        except Exception:  # noqa: BLE001 - no evidence then
            return []

    split = df.withColumn("_sentences", text.sentences(F.col(context)))
    found = _mapped(split, [question, answer, "_sentences"], F.size("_sentences") > 0, "_ids", "array<int>", call, backend(model))
    return found.withColumn(out, chosen(F.col("_sentences"), F.col("_ids"))).drop("_sentences", "_ids")


def chosen(sentences: Column, ids: Column) -> Column:
    """The sentences of the given numbers (from 1), each once, in order, joined by blanks."""
    keep = F.array_sort(F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<int>")), lambda i: (i >= 1) & (i <= F.size(sentences)))))
    return F.coalesce(F.array_join(F.transform(keep, lambda i: F.element_at(sentences, i)), " "), F.lit(""))
