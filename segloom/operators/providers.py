"""Functions that aren't deterministic or are costly (models, text recognition), called once for each group or image.

A provider is made by a factory on the worker, once for each process, and its results are written before they are
used twice. A call that fails is a row with an error, never a failed task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from segloom.functions import boxes
from segloom.operators.ordered import out_batches, rows_of
from segloom.shipping import ship

_MADE: dict[str, Callable] = {}


def _once(name: str, factory: Callable[[], Callable]) -> Callable:
    if name not in _MADE:
        _MADE[name] = factory()
    return _MADE[name]


def called(requests: DataFrame, name: str, factory: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """requests (doc_id, group_no, stage, system, user) with content, the counters of the call, and error.

    The provider takes a request and gives content, prompt_tokens, completion_tokens, model_ms and eval_ms.
    """
    ship(requests.sparkSession)
    kinds = {f.name: f.dataType for f in requests.schema}  # documents go by numbers or by paths
    schema = pa.schema([("doc_id", to_arrow_type(kinds["doc_id"])), ("group_no", pa.int32()), ("stage", pa.string()), ("content", pa.string()), ("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("model_ms", pa.float64()), ("eval_ms", pa.float64()), ("error", pa.string())])

    def one(row: dict, provider: Callable[[dict], dict]) -> dict:
        own = {k: row[k] for k in ("doc_id", "group_no", "stage")}
        try:
            return own | provider(row)
        except Exception as e:  # what a provider raises is data
            return own | {"error": str(e)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = _once(name, factory)
        yield from out_batches((one(row, provider) for row in rows_of(batches)), schema)

    asked = requests.select("doc_id", "group_no", "stage", "system", "user")
    return asked.mapInArrow(run, f"doc_id {kinds['doc_id'].simpleString()}, group_no int, stage string, content string, prompt_tokens long, completion_tokens long, model_ms double, eval_ms double, error string")


def echo_factory(target: str) -> Callable[[], Callable[[dict], dict]]:
    """A provider that puts the target language before each text."""

    def make() -> Callable[[dict], dict]:
        def answer(row: dict) -> dict:
            asked = json.loads(row["user"])
            content = json.dumps({"translations": [{"id": s["id"], "translation": f"[{target}] {s['text']}"} for s in asked]}, ensure_ascii=False)
            return {"content": content, "prompt_tokens": len(row["user"]) // 4, "completion_tokens": len(content) // 4, "model_ms": float(len(content) + 1), "eval_ms": float(len(content))}

        return answer

    return make


def prefixed(target: str, text: Column) -> Column:
    """The same as an expression."""
    return F.concat(F.lit(f"[{target}] "), text)


def sane_capabilities(parsed: Column) -> Column:
    """Of a map from models to structs, the entries whose flag is there."""
    return F.map_filter(parsed, lambda _, v: v["structuredWithThinkOff"].isNotNull())


def detected(images: DataFrame, name: str, factory: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """images (image_id, content) as regions that a recognition engine finds, or an error.

    The engine takes an image's bytes and gives points (a polygon of x and y) or box, text and confidence. Lines without
    a place are left out; a polygon's box is around it, and a line counts as rotated where its first edge leans or its
    box is upright.
    """
    ship(images.sparkSession)
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    schema = pa.schema([("image_id", pa.string()), ("pos", pa.int32()), ("points", pa.list_(point)), ("text", pa.string()), ("confidence", pa.float64()), ("error", pa.string())])

    def of(row: dict, engine: Callable[[bytes], list[dict]]) -> Iterator[dict]:
        try:
            found = [r for r in engine(row["content"]) if r.get("points")]
        except Exception as e:  # what an engine raises is data
            yield {"image_id": row["image_id"], "error": str(e)}
            return
        for k, r in enumerate(found):
            yield {"image_id": row["image_id"], "pos": k, "points": [{"x": float(x), "y": float(y)} for x, y in r["points"]], "text": r["text"], "confidence": float(r["confidence"])}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _once(name, factory)
        yield from out_batches((r for row in rows_of(batches) for r in of(row, engine)), schema)

    rows = images.select("image_id", "content").mapInArrow(run, "image_id string, pos int, points array<struct<x: double, y: double>>, text string, confidence double, error string")
    box = boxes.bounding(F.col("points"))
    placed = rows.withColumn("box", F.when(F.col("points").isNotNull(), box))
    turned = boxes.skewed(F.col("points")) | boxes.vertical_shape(F.col("box"), F.col("text"))
    empty = "cast(null as struct<x: double, y: double, w: double, h: double>)"
    return placed.select("image_id", "pos", "box", F.expr(empty).alias("ink"), "text", "confidence", F.when(turned, F.lit(True)).alias("rotated"), F.lit(None).cast("int").alias("rotation"), "error")
