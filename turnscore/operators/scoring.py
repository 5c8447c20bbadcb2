"""Model calls: M1_batch_score, M2_score_fallback, M3_embed_turns.

The model is a *pluggable scorer*: a factory returning a callable
``(pd.DataFrame) -> pd.Series`` of raw replies. ``mapInArrow`` builds it
once per partition and feeds it slices of Arrow batches, so model state is never
serialised per row and a worker never turns a whole batch of long contexts into
Python strings. Only the model call is Python: prompt rendering (F1) is
done before and reply parsing (F3-F5) after, as JVM column expressions.

The shipped scorer is a deterministic text heuristic (no network, no model
library); a service or local model plugs in through the same factory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FALLBACK_REPLY = "3.0"
ScorerFactory = Callable[[], Callable[[pd.DataFrame], pd.Series]]
#: What a scorer reads, where the input has it.
MODEL_INPUTS = ("uid", "context", "response", "prompt")
#: Rows, and bytes of them, that a scorer gets at once (a longer row comes by itself).
MOST_ROWS, MOST_BYTES = 1024, 4 << 20


class ScorerError(RuntimeError):
    """A failed model call."""


def heuristic_reply(context: str, response: str, prompt: str = "") -> str:
    """Deterministic stand-in for a model reply in the multi-quality format. It
    reads the prompt (its length decides one score), so a prompt that does not
    arrive as rendered shows."""
    n_r, n_c = len(response), len(context)
    appr = 1 + (n_r + n_c) % 5
    rich = 1 + min(4, n_r // 200)
    gram = max(1, 5 - min(4, response.count("!") + response.count("?")))
    rel = 1 + (len(prompt) // 100) % 5
    return f"appropriateness: {appr}, richness: {rich}, grammatical: {gram}, relevance: {rel}"


def heuristic_scorer(fail_prefix: str | None = None) -> ScorerFactory:
    """Factory for the heuristic scorer. ``fail_prefix``: ids whose md5 starts
    with it raise, to exercise the fallback (M2) in tests."""

    def build():
        def call(batch: pd.DataFrame) -> pd.Series:
            out = []
            prompts = batch["prompt"] if "prompt" in batch else [""] * len(batch)
            for uid, ctx, resp, prompt in zip(batch["uid"], batch["context"], batch["response"], prompts):
                if fail_prefix is not None and hashlib.md5(str(uid).encode()).hexdigest().startswith(fail_prefix):
                    out.append(ScorerError(f"service failed for {uid}"))
                else:
                    out.append(heuristic_reply(ctx or "", resp or "", prompt or ""))
            return pd.Series(out, dtype="object")

        return call

    return build


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in order, cut into slices within the bounds (no copies)."""
    if batch.num_rows > 1 and (batch.num_rows > MOST_ROWS or batch.nbytes > MOST_BYTES):
        half = batch.num_rows // 2
        yield from _slices(batch.slice(0, half))
        yield from _slices(batch.slice(half))
    elif batch.num_rows:
        yield batch


def batch_score(df: DataFrame, scorer: ScorerFactory | None = None, keep: tuple[str, ...] | None = None,
                partitions: int | None = None) -> DataFrame:
    """M1 + M2: add ``reply`` and ``call_failed`` to the ``keep`` columns (all by
    default) of ``df``, which carries ``uid``, ``context``, ``response`` and
    optionally ``prompt``; these go to the scorer, kept or not. A failing
    call (exception object or raised error) yields the fallback reply
    ``3.0`` and ``call_failed = 1`` instead of hiding the failure.

    Model calls dominate the cost, so ``partitions`` can spread the prompts
    evenly (hash of the uid) over that many scorer tasks first; by default
    the input partitioning is kept (no shuffle)."""
    factory = scorer or heuristic_scorer()
    kept = [f for f in df.schema.fields if f.name in (keep or df.columns)]
    cols = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("reply", T.StringType()), T.StructField("call_failed", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = factory()  # once per partition
        for batch in batches:
            for part in _slices(batch):
                pdf = part.to_pandas()
                try:
                    raw = call(pdf)
                except Exception:  # noqa: BLE001 - whole slice failed; retry row by row
                    raw = pd.Series([_one(call, pdf.iloc[[i]]) for i in range(len(pdf))], dtype="object")
                failed = [isinstance(r, BaseException) or r is None for r in raw]
                reply = [FALLBACK_REPLY if f else r for r, f in zip(raw, failed)]
                yield pa.record_batch([*[part.column(c) for c in cols], pa.array(reply, pa.string()), pa.array(failed).cast(pa.int32())],
                                      names=schema.names)

    src = df.select(*[c for c in df.columns if c in cols or c in MODEL_INPUTS])
    if partitions:
        src = src.repartition(partitions, F.xxhash64("uid"))
    return src.mapInArrow(run, schema)


def _one(call, row: pd.DataFrame):
    try:
        return call(row).iloc[0]
    except Exception as e:  # noqa: BLE001
        return e


# ------------------------------------------------------------------ M3

EMBED_DIM = 16
_WS_SPLIT = "[ \\t\\n\\r\\x0b\\x0c]+"
Embedder = Callable[[pd.Series], pd.Series]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _token_vector(token: Column, dim: int) -> Column:
    trigrams = F.when(F.length(token) >= 3, F.transform(F.sequence(F.lit(1), F.length(token) - 2), lambda i: F.substring(token, i, F.lit(3))))
    grams = F.concat(F.array(token), F.coalesce(trigrams, F.array().cast("array<string>")))
    hashes = F.transform(grams, lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long"))
    signed = lambda h: F.when(F.shiftright(h, 16).bitwiseAND(F.lit(1)) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    slots = lambda hs: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda d: F.aggregate(hs, F.lit(0.0), lambda a, h: a + F.when(h % dim == d, signed(h)).otherwise(F.lit(0.0))))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda v: _bound(F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v)),
                            lambda n: F.transform(v, lambda x: (x / n).cast("float")))
    return _bound(hashes, lambda hs: _bound(slots(hs), unit))


def hashed_token_vectors(text: Column, dim: int = EMBED_DIM) -> Column:
    """One vector per white-space token (lower-cased): signed feature hashing
    of the token and of its character trigrams (``md5`` of the gram: the
    first 8 hex digits give the slot and, by bit 16, the sign),
    L2-normalised, float32. A column expression, with no Python."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _WS_SPLIT), lambda t: t != "")
    return F.transform(tokens, lambda t: _token_vector(t, dim))


def embed_turns(df: DataFrame, text: str = "response", id_col: str = "uid", dim: int = EMBED_DIM,
                embedder: Callable[[], Embedder] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """M3: per turn, one vector per generated token (``token_vectors``,
    ``ARRAY<ARRAY<FLOAT>>``), beside the ``keep`` columns (scores and gold, say).
    ``embedder`` plugs in a model: a factory, called once per partition, of a
    function from a series of texts to a series of lists of vectors
    (``mapInPandas``); the shipped hashing is column expressions."""
    if embedder is None:
        return df.select(id_col, *keep, hashed_token_vectors(F.col(text), dim).alias("token_vectors"))
    fields = [df.schema[c] for c in (id_col, *keep)]
    schema = T.StructType([*fields, T.StructField("token_vectors", T.ArrayType(T.ArrayType(T.FloatType())))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = embedder()  # once per partition
        for pdf in batches:
            out = pdf[[id_col, *keep]].copy()
            out["token_vectors"] = list(embed(pdf[text]))
            yield out

    return df.select(*dict.fromkeys((id_col, *keep, text))).mapInPandas(run, schema)


def pooled_embeddings(df: DataFrame, text: str = "response", id_col: str = "uid", dim: int = EMBED_DIM,
                      embedder: Callable[[], Embedder] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """M3 + A14: token vectors pooled to one embedding (a text without tokens
    gives zeros), beside the ``keep`` columns."""
    from turnscore.operators.features import max_and_avg_pool

    e = embed_turns(df, text, id_col, dim, embedder, keep)
    # an empty text has no token: a zero vector keeps every embedding the same length
    pooled = F.when(F.size("token_vectors") > 0, max_and_avg_pool("token_vectors")).otherwise(
        F.array_repeat(F.lit(0.0), 2 * dim)
    )
    return e.select(id_col, *keep, F.size("token_vectors").alias("n_tokens"),
                    F.transform(pooled, lambda x: x.cast("float")).alias("embedding"))
