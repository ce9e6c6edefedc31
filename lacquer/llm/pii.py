"""Personal data: patterns with checks, and terms that give protected values away.

Every value that the patterns find is a protected entity. A term discloses it as
far as the corpus lets one infer it: the mutual information of term and entity
over whole documents, as a share of the entity's own information. A term over
the threshold is generalised wherever it stands in a document that holds the
entity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import blocks, cut, drop, ship, stored

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit before the start can't belong to an earlier match, so these look back only to stay linear
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]{2,}")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        if lo < at and (m := DOMAIN.match(text, at + 1)):
            yield lo, (done := m.end())
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the four patterns by kind and start, in code points."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def terms_of(text: str) -> set[str]:
    """The text's terms in lower case: runs of two or more letters and digits, numbers of accounts and cases among them."""
    return {t.lower() for t in set(TERM.findall(text))}


def outside(text: str, spans: list[Span]) -> str:
    """The text with a blank for each span, so that no protected value is a term."""
    out, done = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if b > done:
            out += [text[done : max(a, done)], " "]
            done = b
    return "".join([*out, text[done:]])


def term_spans(text: str, spans: list[Span], wanted: set[str]) -> list[Span]:
    """Where the wanted terms stand outside all spans."""
    edges, done = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if b > done:
            edges.append((done, a))
            done = b
    edges.append((done, len(text)))
    return [(4, m.start(), m.end()) for a, b in edges if b > a for m in TERM.finditer(text, a, b) if m[0].lower() in wanted]


def digest_of(text: str) -> bytes:
    """What rows of equal text have in common; 128 bits, so that different texts don't."""
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def protected(documents: DataFrame) -> DataFrame:
    """(digest, entities, terms) of the rows that hold a protected value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4_000_000):
            rows = []
            for text in part.column(0).to_pylist():
                if text and (spans := base_spans(text)):
                    rows.append((digest_of(text), sorted({f"{KINDS[k]}:{text[a:b].lower()}" for k, a, b in spans}), sorted(terms_of(outside(text, spans)))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())), strict=True)], ["digest", "entities", "terms"])

    return documents.select("text").mapInArrow(run, "digest binary, entities array<string>, terms array<string>")


MOST_BITS = 1 << 25


def slot(key: str | bytes, n: int) -> int:
    return xxhash.xxh64_intdigest(key, 1) & (n - 1)


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Flags set at the hashes of a column, packed: 16 bits a key, at most 4 MB whatever their number. Others' flags only cost time."""
    n = min(MOST_BITS, 1 << max(10, (16 * keys.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([slot(t, n) for t in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["cell", "bits"])

    cells = keys.mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(n >> 5, "<u4")
    words[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().astype(np.uint32)
    return words


def flagged(words: np.ndarray, key: str | bytes) -> bool:
    at = slot(key, 32 * len(words))
    return bool(words[at >> 5] >> (at & 31) & 1)


def document_counts(documents: DataFrame, terms: DataFrame, held: int = 300_000) -> DataFrame:
    """(term, n_term): how many rows hold each of the terms anywhere, counted in the tasks before it is summed."""
    flags = documents.sparkSession.sparkContext.broadcast(bit_filter(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = {}, Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        for part in blocks(batches, "text", 4_000_000):
            for text in part.column(0).to_pylist():
                for term in terms_of(text or ""):
                    want = wanted.get(term)
                    if want is None:
                        want = wanted[term] = flagged(flags.value, term)
                    if want:
                        counts[term] += 1
                if len(wanted) > held:
                    wanted.clear()
                if len(counts) > held:
                    yield rows()
                    counts.clear()
        yield rows()

    counted = documents.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted.join(terms, "term", "left_semi")


#: Into how many parts the rows of one key are dealt where a key may be in a third of all rows.
SALTS = 16
#: Pairs of protected values and terms of one text that one task should make.
PAIRS = 1_000_000


def salted_join(rows: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of rows with a table of one row per key, whose rows are repeated so that no key is one task's alone."""
    # rows are dealt out in any case: Spark would send a table to all tasks by its size before it is repeated
    salted = few.hint("shuffle_merge").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"]).drop("__salt")


def disclosing(documents: DataFrame, threshold: float, contexts: int) -> DataFrame:
    """(digest, terms): of each text that holds protected values, its terms that disclose one of them.

    Counts are of rows; a pair must also stand in `contexts` different texts.
    With n_both at most n_entity and n_term, a term of more than
    n * (n_entity / n) ** threshold rows can't reach the threshold, so that
    frequent terms meet no entity.
    """
    n = documents.count()
    found = stored(protected(documents), "protected")
    texts = found.groupBy("digest").agg(F.count("*").alias("rows"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    texts = stored(texts, "protected-texts")
    # a text of many values and many terms is dealt out in parts, so that a task makes about a million of its pairs
    parts = F.ceil(F.size("entities") * F.size("terms").cast("long") / PAIRS).cast("int").alias("parts")
    texts = texts.select("*", F.greatest(parts, F.lit(1)).alias("parts"))
    held = texts.select("digest", "rows", "parts", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.sum("rows").alias("n_entity"), F.count("*").alias("n_texts")).where((F.col("n_texts") >= contexts) & (F.col("n_entity") < n)).drop("n_texts")
    entities = stored(entities.withColumn("most", F.lit(float(n)) * F.pow(F.col("n_entity") / F.lit(float(max(n, 1))), F.lit(threshold)) * (1 + 1e-9)), "entities")
    most = entities.agg(F.max("most")).first()[0] or 0.0
    held = stored(salted_join(held, entities, "entity", "digest"), "held")
    own = texts.join(held.select("digest").distinct(), "digest", "left_semi").select("digest", "parts", F.explode("terms").alias("term"))
    several = stored(own.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= contexts).select("term"), "terms")
    counts = stored(document_counts(documents, several).where(F.col("n_term") <= most), "counts")
    everywhere = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = salted_join(own, counts, "term", "digest").withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int")).drop("parts")
    pairs = everywhere.join(dealt, ["digest", "part"]).where(F.col("n_term") <= F.col("most"))
    pairs = stored(pairs.select("digest", "rows", "entity", "term", "n_entity", "n_term"), "pairs")
    shared = F.log2(F.col("n_both") * F.lit(float(n)) / (F.col("n_entity") * F.col("n_term")))
    judged = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("rows").alias("n_both"), F.count("*").alias("n_texts"))
    told = judged.where((F.col("n_texts") >= contexts) & (shared >= F.lit(threshold) * F.log2(F.lit(float(n)) / F.col("n_entity")) - 1e-9)).select("entity", "term")
    out = stored(pairs.join(told, ["entity", "term"], "left_semi").groupBy("digest").agg(F.collect_set("term").alias("terms")), "disclosing")
    for table in (found, texts, entities, held, several, counts, pairs):
        drop(documents.sparkSession, table)
    return out


def marked(documents: DataFrame, threshold: float, contexts: int, make: Callable[[pa.RecordBatch, list[tuple[list[Span], list[Span]]]], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """make(batch, base and term spans of each row) of all rows.

    Spans are found in the task that holds the text. Only rows whose text may
    have disclosing terms travel, to fetch them by the text's digest.
    """
    spark = documents.sparkSession
    ship(spark)
    told = disclosing(documents.select(F.col("text").cast("string").alias("text")), threshold, contexts)
    flags = spark.sparkContext.broadcast(bit_filter(told.select("digest")))
    at = documents.columns.index("text")

    def spans_of(text: str | None, wanted: list[str] | None) -> tuple[list[Span], list[Span]]:
        base = base_spans(text) if text else []
        return base, term_spans(text, base, set(wanted)) if wanted else []

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4_000_000):
            texts = part.column(at).to_pylist()
            other = [not t or not flagged(flags.value, digest_of(t)) for t in texts]
            yield make(part.filter(pa.array(other)), [spans_of(t, None) for t, o in zip(texts, other, strict=True) if o])

    def told_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4_000_000):
            digests = [digest_of(t) if t else b"" for t in part.column(at).to_pylist()]
            mine = pa.array([bool(d) and flagged(flags.value, d) for d in digests])
            yield pa.RecordBatch.from_arrays([part.to_struct_array(), pa.array(digests, pa.binary())], ["row", "digest"]).filter(mine)

    def with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_struct_array(batch.column(0))
            lo = 0
            for part in cut(own, "text", 4_000_000):
                terms = batch.column(1).slice(lo, part.num_rows).to_pylist()
                lo += part.num_rows
                yield make(part, list(map(spans_of, part.column(at).to_pylist(), terms)))

    few = told.hint("shuffle_merge").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a row's own columns travel in a struct, whatever their names; copies of one text are dealt out
    travelling = documents.mapInArrow(told_ones, T.StructType([T.StructField("row", documents.schema), T.StructField("digest", T.BinaryType())]))
    dealt = travelling.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = dealt.join(few, ["digest", "salt"], "left").select("row", "terms")
    return documents.mapInArrow(plain, schema).unionByName(joined.mapInArrow(with_terms, schema))


SPANS = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
SPANNED = "doc_id long, base array<struct<rank:int,start:int,end:int>>, spans array<struct<rank:int,start:int,end:int>>"


def span_lists(lists: list[list[Span]]) -> pa.Array:
    flat = np.array([x for spans in lists for x in spans], np.int32).reshape(-1, 3)
    at = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["rank", "start", "end"])).cast(SPANS)


def spans(documents: DataFrame, threshold: float = 0.9, contexts: int = 2) -> DataFrame:
    """doc_id, base and spans (arrays of rank, start, end by rank and start); spans has the disclosing terms' too.

    Corpus counts cover all rows, those of null and repeated doc_ids included;
    exact copies count as rows but are one context. Null and empty texts have no
    spans. Every row is reported with the spans of its own text.
    """

    def make(part: pa.RecordBatch, found: list[tuple[list[Span], list[Span]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), span_lists([b for b, _ in found]), span_lists([b + t for b, t in found])], ["doc_id", "base", "spans"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return marked(own, threshold, contexts, make, SPANNED)


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.rank), s.start.cast("string"), s.end.cast("string"))), ",")


def report(documents: DataFrame, **options: float) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s.rank == k)).cast("long").alias(f"n_{KINDS[k]}")
    return spans(documents, **options).select("doc_id", *map(n, range(4)), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def replaced(text: str, found: list[Span]) -> str:
    """The text with each span generalised to its kind; of overlapping spans the first is replaced, then what is left of the others."""
    out, done = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in found):
        if end > done:
            out += [text[done : max(start, done)], f"[{KINDS[kind].upper()}]"]
            done = end
    return "".join([*out, text[done:]])


def sanitise(documents: DataFrame, threshold: float = 0.9, contexts: int = 2) -> DataFrame:
    """All columns of all documents with personal data and disclosing terms generalised, and n_chars, if there, brought up to date.

    A row is changed by its own text alone: null and repeated doc_ids are rows
    like any other, and null and empty texts stay.
    """
    schema = documents.schema

    def make(part: pa.RecordBatch, found: list[tuple[list[Span], list[Span]]]) -> pa.RecordBatch:
        at = part.schema.get_field_index("text")
        if any(b or t for b, t in found):
            texts = [replaced(t, b + more) if b or more else t for t, (b, more) in zip(part.column(at).to_pylist(), found, strict=True)]
            part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
        return part

    out = marked(documents, threshold, contexts, make, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out
