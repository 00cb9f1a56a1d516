"""Personal data by exact patterns and by bootstrapped contextual extraction.

Base patterns give the seeds: e-mail addresses, IP addresses, card and phone
numbers; tokens of a well-known secret format are weaker ones.  The words
before and after a seed, one or two of them, form lexical patterns; the same
patterns stand beside other tokens that look like identifiers.  Spark scores
the graph of patterns and instances in rounds: a pattern is as good as the
instances at its places, an instance as good as its other patterns together.
Identifiers beside patterns of high confidence are found, whatever they look
like.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import attach, hot_keys
from . import kernels as K
from .store import store

KINDS = ("email", "ip", "card", "phone")
#: What a contextual find is called; it sorts after the base kinds.
FOUND = "id"

#: Rounds of scoring; known distinct instances that a pattern of two words needs, and one of a single word; confidence that it needs.
ROUNDS, SUPPORT, SUPPORT_ONE, CONFIDENCE = 3, 5, 20, 0.8
#: What an instance of unknown worth counts against a pattern, and what is added to the doubt of each pattern, so that few instances prove less.
UNKNOWN, SMOOTH = 0.5, 0.5
#: Belief in a token of a secret's format.
FORMAT_BELIEF = 0.9
#: Patterns whose places are counted in one pass over the texts (8 bytes each on the executors, and as much for counts); more take further passes.
SLICE_PATTERNS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A number that fails from its first digit fails from every later one, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens that look like identifiers: six characters or more with a digit, plain punctuation aside.
_CANDIDATE = re.compile(r"[^\s\"'(),;:=<>\[\]{}]{6,}")
#: Formats of secrets: digests and keys in hex, UUIDs, access keys and tokens of hosting services, social security numbers.
_FORMAT = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9]{3}-[0-9]{2}-[0-9]{4})"
)
# Context words are those that the kernel counts: everything but ASCII characters that are no letters.
_WORD, _GAP = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BEFORE = regex.compile(rf"(?r)(?:({_WORD}){_GAP})?({_WORD}){_GAP}")
_AFTER = regex.compile(rf"{_GAP}({_WORD})(?:{_GAP}({_WORD}))?")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in code points, in order; per kind leftmost and not overlapping."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns beside a place, on its own line: one and two words before (``l:``) and after (``r:``), A-Z lower-cased."""
    out = []
    if m := _BEFORE.match(text, 0, start):
        out.append(f"l:{m[2]}")
        if m[1]:
            out.append(f"l:{m[1]} {m[2]}")
    if m := _AFTER.match(text, end):
        out.append(f"r:{m[1]}")
        if m[2]:
            out.append(f"r:{m[1]} {m[2]}")
    return [x.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for x in out]


def _name(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates: their patterns, instance (a hash), belief (1 a seed, 0 unknown), whether a candidate, and place."""
    out = [{"patterns": contexts(text, a, b), "instance": _name(text[a:b]), "belief": 1.0, "candidate": False, "start": a, "end": b} for a, _, b in spans]
    if _DIGIT.search(text):
        taken, k = sorted((a, b) for a, _, b in spans), 0
        for m in _CANDIDATE.finditer(text):
            token = m[0].rstrip(".!?")
            a, b = m.start(), m.start() + len(token)
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if len(token) >= 6 and _DIGIT.search(token) and not any(x < b and a < y for x, y in taken[k : k + len(KINDS)]):
                belief = FORMAT_BELIEF if _FORMAT.fullmatch(token) else 0.0
                out.append({"patterns": contexts(text, a, b), "instance": _name(token), "belief": belief, "candidate": True, "start": a, "end": b})
    return out


_MENTIONS = "array<struct<patterns: array<string>, instance: long, belief: double, candidate: boolean, start: int, end: int>>"
_MENTION_TYPE = pa.list_(
    pa.struct(
        [("patterns", pa.list_(pa.string())), ("instance", pa.int64()), ("belief", pa.float64()), ("candidate", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]
    )
)
_SPANS = "array<struct<start: int, kind: int, end: int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, seen = [], []
        for text in batch.column(2).to_pylist():
            found = base_spans(text) if text else []
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
            seen.append(mentions(text, found) if text else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, _SPAN_TYPE), pa.array(seen, _MENTION_TYPE)], names=["id", "text_hash", "base", "mentions"]
        )


_LETTERS = K.separator_table(bytes(b for b in range(128) if not chr(b).isalpha()))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, hits, gram): the hash of each pattern's one or two words."""
    for batch in batches:
        words, first = K.word_hashes(*K.utf8_rows(pa.array([p[2:] for p in batch.column(0).to_pylist()], pa.large_string())), _LETTERS)
        size = np.diff(first)
        assert ((size == 1) | (size == 2)).all(), "a pattern has one word or two"
        gram = words[first[:-1]].copy()
        pair, index = K.gram_hashes(words, first, 2)
        gram[size == 2] = pair[index[:-1][size == 2]]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gram.view(np.int64))], names=["pattern", "hits", "gram"])


def _places(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, body, at in K.chunks(batch.column(0)):
                words, first = K.word_hashes(body, at, _LETTERS)
                for gram in (words, K.gram_hashes(words, first, 2)[0]):
                    spot = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                    total += np.bincount(spot[known[spot] == gram], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(total[some])], names=["gram", "n"])

    return run


def specific(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, blank) of those that could reach ``CONFIDENCE``, from rows (pattern, hits); blank counts places without an identifier.

    Words as common as ``of the`` stand beside anything: a pattern whose places
    in ``texts`` are mostly blank stays below the threshold even if all its
    instances are seeds, so leaving it out loses nothing.  Every pattern is
    tested: their hashes go to the executors in slices, one pass each.
    """
    spark = texts.sparkSession
    hashed = store(patterns.select("pattern", "hits").mapInArrow(_hashed, "pattern string, hits long, gram long"), "patterns")
    many = max(1, -(-hashed.count() // SLICE_PATTERNS))
    counted = None
    for k in range(many):
        grams = hashed.where(F.pmod("gram", F.lit(many)) == k).select("gram").distinct().toArrow().column(0).to_numpy().view(np.uint64)
        if not len(grams):
            continue
        shared = spark.sparkContext.broadcast(np.sort(grams))
        part = store(texts.mapInArrow(_places(shared), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "places")
        shared.destroy()
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return store(hashed.select("pattern", F.lit(0).cast("long").alias("blank")), "specific")
    tested = hashed.join(counted, "gram", "left").withColumn("blank", F.greatest(F.coalesce("n", F.lit(0)) - F.col("hits"), F.lit(0)))
    return store(tested.where(F.col("hits") >= CONFIDENCE * (F.col("hits") + F.col("blank") + SMOOTH)).select("pattern", "blank"), "specific")


def good_patterns(texts: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(pattern, confidence, support) of high confidence, from rows (pattern, instance, belief), scored in rounds.

    With b the belief in the instance at each place of a pattern, its
    confidence is sum(b) / (sum(b) + UNKNOWN * sum(1 - b) + blank places +
    SMOOTH).  An instance is believed as much as it was known at the start, or
    1 - product(1 - confidence) over its good patterns other than the one that
    is scored, whichever is more.  Support counts distinct instances that are
    believed.
    """
    needs = F.when(F.col("pattern").contains(" "), F.lit(SUPPORT)).otherwise(F.lit(SUPPORT_ONE))
    edges = store(mentioned.groupBy("pattern", "instance").agg(F.max("belief").alias("known"), F.count(F.lit(1)).alias("n")), "mentions")
    candidates = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("most"), F.sum("n").alias("hits")).where(F.col("most") >= needs)
    kept = specific(texts, candidates)
    hot = hot_keys(edges, "pattern", edges.count())
    graph = store(attach(edges, kept, "pattern", hot), "graph")
    total = graph.count()
    hot_patterns, hot_instances = hot_keys(graph, "pattern", total), hot_keys(graph, "instance", total)
    # an instance is what it is wherever it stands
    known = graph.groupBy("instance").agg(F.max("known").alias("known"))
    graph = store(attach(graph.drop("known"), known, "instance", hot_instances), "graph")
    believed = graph.withColumn("belief", F.col("known"))
    good = None
    for k in range(ROUNDS):
        scored = believed.groupBy("pattern").agg(
            F.sum(F.col("n") * F.col("belief")).alias("yes"),
            F.sum(F.col("n") * (1 - F.col("belief"))).alias("unknown"),
            F.sum(F.when(F.col("belief") >= CONFIDENCE, 1).otherwise(0)).alias("support"),
            F.first("blank").alias("blank"),
        )
        confidence = F.col("yes") / (F.col("yes") + UNKNOWN * F.col("unknown") + F.col("blank") + SMOOTH)
        good = scored.select("pattern", confidence.alias("confidence"), "support").where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= needs))
        if k < ROUNDS - 1:
            good = store(good, "good")
            doubted = attach(graph, good.select("pattern", F.log1p(-F.col("confidence")).alias("doubt")), "pattern", hot_patterns, "left")
            doubted = store(doubted.withColumn("doubt", F.coalesce("doubt", F.lit(0.0))), "graph")
            whole = doubted.groupBy("instance").agg(F.sum("doubt").alias("whole"))
            believed = attach(doubted, whole, "instance", hot_instances).withColumn(
                "belief", F.greatest("known", 1 - F.exp(F.col("whole") - F.col("doubt")))
            )
    return store(good, "good")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, base, mentions) of all rows, stored, and (id, text_hash, found) of rows with contextual finds.

    Rows with the same id and text have the same finds; ``found`` has each once.
    """
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    seen = store(given.mapInArrow(_find, f"id {kind}, text_hash long, base {_SPANS}, mentions {_MENTIONS}"), "pii")
    each = seen.select("id", "text_hash", F.explode("mentions").alias("m")).select("id", "text_hash", "m.*")
    rows = each.withColumn("pattern", F.explode("patterns")).drop("patterns")
    good = good_patterns(given.select("text"), rows.select("pattern", "instance", "belief"))
    asked = store(rows.where("candidate").select("id", "text_hash", "pattern", "start", "end"), "asked")
    hits = attach(asked, good.select("pattern", "confidence"), "pattern", hot_keys(asked, "pattern", asked.count()))
    place = F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")
    found = hits.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(place)).alias("found"))
    return seen, found


def _digest(spans: str) -> str:
    names = "element_at(array({}), x.kind + 1)".format(", ".join(f"'{k}'" for k in (*KINDS, FOUND)))
    return f"array_join(transform({spans}, x -> concat_ws(':', {names}, x.start, x.end)), ',')"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base spans, spans has the contextual ones
    (kind ``id``) too; ``kind:start:end`` in code points, end exclusive, by
    start and kind, comma-joined.  A null, empty or clean text has zero counts,
    the hash of the empty string and an empty list.  Repeated rows stay; other
    columns are ignored; texts are read whole.
    """
    seen, found = find(docs, id_col, text_col)
    found = found.select(F.col("id").alias("i"), F.col("text_hash").alias("h"), "found")
    both = seen.drop("mentions").join(found, F.col("id").eqNullSafe(F.col("i")) & F.col("text_hash").eqNullSafe(F.col("h")), "left")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = "array_sort(concat(base, coalesce(found, array())))"
    return both.select(
        F.col("id").alias(id_col), *counts, F.sha2(F.expr(_digest("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_digest(every)).alias("spans")
    )


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = (*KINDS, FOUND)
    for batch in batches:
        out = []
        for text, extra in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                spans = sorted([*base_spans(text), *((x["start"], x["kind"], x["end"]) for x in extra or ())])
                parts, at = [], 0
                for a, k, b in spans:
                    if a >= at:
                        parts += [text[at:a], f"[{names[k].upper()}]"]
                    at = max(at, b)
                text = "".join([*parts, text[at:]]) if spans else text
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], names=["text", *batch.schema.names[2:]])


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one mark.

    Null texts stay null; all columns and rows stay.
    """
    _, found = find(docs, id_col, text_col)
    found = found.select(F.col("id").alias("__i"), F.col("text_hash").alias("__h"), F.col("found").alias("__found"))
    both = docs.join(found, docs[id_col].eqNullSafe(F.col("__i")) & (F.xxhash64(docs[text_col]) == F.col("__h")), "left")
    others = [c for c in docs.columns if c != text_col]
    given = both.select(docs[text_col].alias("text"), F.col("__found"), *(docs[c].alias(f"c{k}") for k, c in enumerate(others)))
    fields = "".join(f", c{k} {given.schema[f'c{k}'].dataType.simpleString()}" for k in range(len(others)))
    out = given.mapInArrow(_mask, f"text string{fields}")
    names = {c: f"c{k}" for k, c in enumerate(others)} | {text_col: "text"}
    return out.select(*(F.col(names[c]).alias(c) for c in docs.columns))
