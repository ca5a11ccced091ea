"""Secret scans through an incremental ledger of content-addressed blobs.

Every version of every path is named by the SHA-256 of its text. A blob is scanned once for each
rule version: pairs of blob and rule version that the ledger already holds are skipped, copies
are scanned as one blob, and findings are joined back to all paths and versions of the blob.

A ledger is a folder of two tables, ``entries(blob, kind, version)`` of all pairs scanned and
``findings(blob, kind, version, start, end)``. Each increment appends a part to both; a part
counts once both are complete, so that an increment that failed half way is scanned again.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, fresh, handing_back, hot_keys, salted_join, scratch, shared_dir, stored

# The rules of the contract; group to measure, and its least length.
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]+"
_HEX = r"[0-9a-f]+"

#: kind -> (version, pattern, flags, measured group, least length). Order is the order of kinds.
RULES: dict[str, tuple[int, str, int, int, int]] = {
    "assign": (1, _ASSIGN, re.IGNORECASE | re.ASCII, 2, 6),
    "access": (1, _ACCESS, 0, 0, 20),
    "hex": (1, _HEX, 0, 0, 24),
    # with its body and end line, where they follow
    "pem": (2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]++-----END [A-Z ]*PRIVATE KEY-----)?", 0, 0, 0),
    # begins where a run of its characters begins, so that no run is read more than three times
    "jwt": (2, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++", 0, 0, 0),
}
BASE = ("assign", "access", "hex")
BROADCAST_SPANS = 200_000  # spans of about 60 bytes each; more are joined by a shuffle of the texts

#: Cheap necessary conditions on the text or its lower-case form; a kind without one is always scanned.
_TRIGGERS = {"access": ("AKIA",), "pem": ("-----BEGIN ",), "jwt": ("eyJ",)}
_NAMES = ("passw", "secret", "token", "apikey", "api_key")


def scan_text(text: str, rules: dict = RULES) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of one text, in code points, by start and then by order of kind."""
    found = []
    for order, (kind, (_, pattern, flags, group, least)) in enumerate(rules.items()):
        if kind in _TRIGGERS and not any(t in text for t in _TRIGGERS[kind]):
            continue
        if pattern == _ASSIGN and not any(n in text.lower() for n in _NAMES):
            continue
        if pattern == _HEX and not re.search(f"[0-9a-f]{{{least}}}", text):
            continue
        for m in re.compile(pattern, flags).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(rules: dict):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                todo = part.column("rules").to_pylist()
                spans = [
                    [{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t, {k: rules[k] for k in rules if k in set(r)})]
                    for t, r in zip(part.column("text").to_pylist(), todo)
                ]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("blob"), pa.array(todo, pa.list_(pa.string())), pa.array(spans, kind)], ["blob", "rules", "spans"])

    return run


def blob_of(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


_ENTRY, _FINDING = "blob binary, kind string, version int", "blob binary, kind string, version int, start long, end long"


def _read(spark: SparkSession, ledger: str, table: str, schema: str) -> DataFrame:
    """A table of a ledger, of its complete parts only; an empty one of a ledger that is new."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/*/{table}/_SUCCESS")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [str(p.getPath().getParent().getParent()) for p in store.globStatus(path) or []]
    done = [p for p in parts if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/entries/_SUCCESS"))]
    return spark.read.schema(schema).parquet(*(f"{p}/{table}" for p in done)) if done else spark.createDataFrame([], schema)


def _current(spark: SparkSession, rules: dict) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, r[0]) for k, r in rules.items()], "kind string, version int"))


def scan(versions: DataFrame, ledger: str, rules: dict = RULES) -> int:
    """Scans the blobs of ``versions`` for the rule versions that ``ledger`` lacks; appends to it.

    ``versions`` has ``text`` (null: empty) besides any columns that name paths and versions.
    Returns how many blobs were scanned.
    """
    spark = versions.sparkSession
    every = F.array(*map(F.lit, rules))
    known = _read(spark, ledger, "entries", _ENTRY).join(_current(spark, rules), ["kind", "version"], "left_semi").groupBy("blob").agg(F.collect_set("kind").alias("known"))
    texts = versions.select(blob_of().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    due = F.array_except(every, F.coalesce("known", F.array().cast("array<string>")))
    todo = texts.join(known.hint("merge"), "blob", "left").select("blob", "text", due.alias("rules")).filter(F.size("rules") > 0)
    with scratch(spark):
        scanned = stored(todo.mapInArrow(handing_back(_scan(rules)), "blob binary, rules array<string>, spans array<struct<kind: string, start: long, end: long>>"))
        part = f"{ledger}/{uuid.uuid4().hex}"
        with_version = lambda df: df.join(_current(spark, rules), "kind")
        found = with_version(scanned.select("blob", F.explode("spans").alias("s")).select("blob", "s.kind", "s.start", "s.end"))
        found.select("blob", "kind", "version", "start", "end").write.parquet(f"{part}/findings")
        with_version(scanned.select("blob", F.explode("rules").alias("kind"))).select("blob", "kind", "version").write.parquet(f"{part}/entries")
        return scanned.count()


def findings(spark: SparkSession, ledger: str, rules: dict = RULES) -> DataFrame:
    """``blob, found``: the spans of each blob under the current rule versions, by start and order of kind."""
    order = F.array_position(F.array(*map(F.lit, rules)), F.col("kind"))
    span = F.struct("start", order.alias("nth"), "kind", "end")
    now = _read(spark, ledger, "findings", _FINDING).join(_current(spark, rules), ["kind", "version"], "left_semi")
    # a part that was written twice counts once
    return now.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("found"))


def _digest(spans):
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, shown), ",")


def document_secrets(docs: DataFrame, rules: dict = RULES, ledger: str | None = None, increments: int = 1) -> DataFrame:
    """``doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans, found`` of every document.

    ``found`` has all spans by start and order of kind, ``spans`` the same as text. Each row is a
    version of its own: rows that repeat an id or a text each get the findings of their blob.
    A null or empty text has none. Texts are scanned whole. An empty table gives an empty result;
    columns besides ``doc_id`` and ``text`` are ignored.

    Documents come in ``increments``, by hash of their ids, and each scans only blobs and rule
    versions that ``ledger`` (a folder, by default a new one) lacks from before.
    """
    ledger = ledger or shared_dir(docs.sparkSession)
    for n in range(increments):
        scan(docs.select("text") if increments == 1 else docs.filter(crc_mod(F.col("doc_id"), increments) == n).select("text"), ledger, rules)
    with scratch(docs.sparkSession) as s:
        paths = stored(docs.select("doc_id", blob_of().alias("blob")))
        s.keep(paths)
    found = findings(docs.sparkSession, ledger, rules)
    none = F.array().cast("array<struct<start: long, nth: long, kind: string, end: long>>")
    out = salted_join(paths, found, "blob", hot_keys(paths, "blob"), "left").withColumn("found", F.coalesce("found", none))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return out.select(
        "doc_id", "blob", *(of(k).alias(f"n_{k}") for k in BASE), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("found")).alias("spans"), "found"
    )


def redacted(docs: DataFrame, rules: dict = RULES, ledger: str | None = None) -> DataFrame:
    """``docs``, all columns, with every found secret replaced by ``[kind]``; overlapping spans become one.

    ``n_chars``, if there is such a column, becomes the length of a changed text. Null texts stay
    null, repeated rows are changed alike, an empty table stays empty, and columns may have any
    names besides ``text``.
    """
    ledger = ledger or shared_dir(docs.sparkSession)
    scan(docs.select("text"), ledger, rules)
    blob, cuts = fresh(docs, "blob"), fresh(docs, "cuts")
    found = findings(docs.sparkSession, ledger, rules).select(F.col("blob").alias(blob), F.col("found").alias(cuts))
    named = docs.withColumn(blob, blob_of())
    if _read(docs.sparkSession, ledger, "findings", _FINDING).count() <= BROADCAST_SPANS:
        joined = named.join(F.broadcast(found), blob, "left")
    else:
        joined = salted_join(named, found, blob, hot_keys(named.select(blob), blob), "left", by="doc_id" if "doc_id" in docs.columns else None)
    # what follows the last cut stays open; a cut that begins before that point only moves it
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    part = lambda lo, n: F.substring(joined["text"], (lo + 1).cast("int"), n.cast("int"))

    def cut(acc, s):
        head = F.concat(acc["text"], part(acc["at"], s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(s["start"] >= acc["at"], head).otherwise(acc["text"]).alias("text"), F.greatest(s["end"], acc["at"]).alias("at"))

    done = F.aggregate(joined[cuts], start, cut, lambda acc: F.concat(acc["text"], part(acc["at"], F.length(joined["text"]))))
    changed = joined[cuts].isNotNull()
    out = joined.withColumn("text", F.when(changed, done).otherwise(joined["text"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """The contract's digest of base spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE).encode()).hexdigest()
