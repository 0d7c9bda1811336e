"""Secret scan with multipart credential linking.

A scan of every whole text finds the base kinds (assign, access, hex), which always count, and weak parts, which alone mean
nothing: `login` (a user or account name being assigned), `opaque` (a bare token of 20 or more letters and digits of mixed
kind) and `endpoint` (a URL or host with a port). Parts have a role: identifier (access, login), secret (assign, hex, opaque)
or endpoint. An interval join links each weak part to parts of the other roles whose start lies within `scope` code points of
its own: parts are counted per document, role and block of `scope` code points (least and greatest start), so that a weak
part meets three rows a role rather than every part. Reported are

* a login or an opaque token, if the other of identifier and secret co-occurs,
* an endpoint, if both co-occur.

Base spans stay whatever is linked, even where a weak span overlaps one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, stored, texts

#: Base kinds in the order of equal starts, then the weak ones.
KINDS = ("assign", "access", "hex", "login", "opaque", "endpoint")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "login": "identifier", "opaque": "secret", "endpoint": "endpoint"}
SCOPE = 300


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Letters of ASCII in either case, and of nothing else: no flag, as IGNORECASE would take two more letters.
_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + f"|{_any_case('api')}_?{_any_case('key')}"
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal: shorter ones are what a filter would drop
_LOGIN = re.compile(rf"""\b(?:{'|'.join(map(_any_case, ('username', 'user', 'login', 'account', 'client_id', 'access_key_id')))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{{3,}})""")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_DIGIT, _CAPITAL, _SMALL = (re.compile(x).search for x in ("[0-9]", "[A-Z]", "[a-z]"))
#: A URL, or a whole run of a host name's characters with a port. No pattern here looks at a character of a long run more than a few times.
_ENDPOINT = re.compile(r"""[a-z][a-z0-9+]{1,12}://[^\s"'<>|]+|(?<![A-Za-z0-9.-])[A-Za-z0-9.-]++:[0-9]{2,5}(?![A-Za-z0-9_])""")


def _endpoint(m: re.Match) -> tuple[int, int, int] | None:
    """The span of an endpoint: of a run, its last host name of two or more labels with the port."""
    if "://" in m[0]:
        return m.start(), 5, m.end()
    host = m[0].rpartition(":")[0]
    name = host.rpartition("..")[2].lstrip(".-")
    return (m.start() + len(host) - len(name), 5, m.end()) if "." in name[:-1] and name[-1] != "." else None


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, weak) spans as (start, kind's number, end), each in order."""
    base, weak = [], []
    folded = text.lower()
    if "passw" in folded or "secret" in folded or "token" in folded or "api" in folded:
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "user" in folded or "login" in folded or "account" in folded or "client_id" in folded or "access_key_id" in folded:
        weak += [(m.start(), 3, m.end()) for m in _LOGIN.finditer(text)]
    if "://" in text or ":" in text:
        weak += [x for x in map(_endpoint, _ENDPOINT.finditer(text)) if x]
    base.sort()
    if any(k in (1, 3) for _, k, _ in base + weak):  # an opaque token needs an identifier in its own text
        held, reach = iter(base), 0
        ahead = next(held, None)
        for m in _OPAQUE.finditer(text):
            while ahead and ahead[0] <= m.start():
                reach, ahead = max(reach, ahead[2]), next(held, None)
            x = m[0]
            if m.end() > reach and _DIGIT(x) and _CAPITAL(x) and _SMALL(x) and not x.startswith("AKIA"):  # not what a base span holds already
                weak.append((m.start(), 4, m.end()))
    return base, sorted(weak)


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, base, weak) for every row, as arrays of (start, kind, end)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [spans(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in x[i]] for x in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "base", "weak"])

    return texts(docs, key).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, base {_SPAN}, weak {_SPAN}")


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, added): the weak spans of each row of `scanned` (row, base, weak) whose complementary parts co-occur within `scope`.

    Rows without any are left out.
    """
    role = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (k, ROLES[name])])
    # Only a row that has a weak part, and parts of two roles at least, can report one.
    able = scanned.filter((F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1))
    parts = able.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", role[F.col("p.kind")].alias("role"), F.col("p.start").alias("start"), F.floor(F.col("p.start") / scope).alias("block"))
    blocks = parts.groupBy("row", "role", "block").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = able.select("row", F.explode("weak").alias("p")).select("row", "p", role[F.col("p.kind")].alias("own"))
    b = F.floor(F.col("p.start") / scope)
    asked = weak.withColumn("block", F.explode(F.array(b - 1, b, b + 1)))
    near = (F.col("role") != F.col("own")) & (F.col("last") >= F.col("p.start") - scope) & (F.col("first") <= F.col("p.start") + scope)
    linked = asked.join(blocks, ["row", "block"]).filter(near).groupBy("row", "p", "own").agg(F.collect_set("role").alias("roles"))  # two roles at most
    has = lambda x: F.array_contains("roles", x)
    whole = F.when(F.col("own") == "endpoint", has("identifier") & has("secret")).when(F.col("own") == "identifier", has("secret")).otherwise(has("identifier"))
    return linked.filter(whole).groupBy("row").agg(F.array_sort(F.collect_list("p")).alias("added"))  # of one text's spans


def find(docs: DataFrame, scope: int = SCOPE, key: str = "doc_id") -> DataFrame:
    """A row per row of `docs`: key, base, added; spans are (start, kind, end) in code points, end exclusive, in order.

    Null and empty texts have none. Rows of equal key and text each keep their row; keys may be null.
    """
    scanned = stored(scan(docs, key).withColumn("row", F.monotonically_increasing_id()))
    return scanned.join(link(scanned, scope), "row", "left").select(key, "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[REDACTED]", salts: int = 16) -> DataFrame:
    """`docs` with every base and linked span of their texts replaced by `mark`; all rows and other columns stay, null texts too.

    Spans come back to their texts by a digest of the text: rows of equal text have equal spans. Texts with spans are one row a
    text by then; it is dealt to `salts` tasks, and the rows of a text (or of null) are spread over these.
    """
    found = find(docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash"), "text"), scope, "hash")
    found = found.select(F.col("hash").alias("_hash"), F.array_sort(F.concat("base", "added")).alias("_spans")).filter(F.size("_spans") > 0)
    found = found.groupBy("_hash").agg(F.first("_spans").alias("_spans")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    names, renamed = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    text = renamed[names.index("text")]
    salted = docs.toDF(*renamed).withColumns({"_hash": F.unhex(F.md5(F.col(text).cast("binary"))), "_salt": (F.monotonically_increasing_id() % salts).cast("int")})
    joined = salted.join(found, ["_hash", "_salt"], "left")
    at, out = renamed.index(text), docs.toDF(*renamed).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            new = [cover(t, s, mark) if s else t for t, s in zip(batch.column(at).to_pylist(), batch.column(len(renamed)).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(renamed)])], names=renamed)

    return joined.select(*renamed, "_spans").mapInArrow(run, out).toDF(*names)


def cover(text: str, found: list[dict], mark: str) -> str:
    """`text` with the spans (by start) replaced; spans that touch or overlap become one."""
    out, at = [], 0
    for s in found:
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined).

    Every row keeps its row, repeated ones too, and null doc_ids; null and empty texts have no spans. Base spans are whole
    matches. Texts of any length are scanned whole, in time that grows with their length. An empty table gives no rows; other
    columns are not read.
    """
    names = F.array(*map(F.lit, KINDS))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(told(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        told(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
