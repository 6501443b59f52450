"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

Base entities (e-mail, IPv4, card, phone) come from fixed patterns and are seeds. Each seed induces patterns of its kind: the word before
it and the word after it, the two words before and the two after, all in lower case without outer punctuation, and its own form (its digits
as 9, runs of letters as a, white space as a blank, and whether card digits have a right check digit). Candidates are other identifier-like tokens
(those with a digit or an ``@`` that no base span covers) and what can be cut out of base matches that failed: numbers that stand side by side, and
phones broken by other white space than a blank. They meet the same patterns. Spark scores the bipartite graph of patterns
and instances for ``rounds`` rounds: a pattern's confidence is the share of its distinct instances that are known, so copies of a
document count once. An instance is known once a confident pattern with enough support extracts one of its mentions and it fits the kind, and
is then known in all its contexts, which can make further patterns confident. Forms are judged by seeds alone: a form that candidates
brought in would extract all that looks like them. Confident patterns add the spans of the candidates they extract; a known instance's mention that
no confident pattern extracts is evidence only.

The graph holds one row per (pattern, instance), made distinct by partial aggregation in each task. Instances and patterns meet in joins,
so nothing grows with a hot context in one task. Texts are read whole;
null counts as empty; a text without entities returns one row with no spans. Every input row is a row of the result, whether its
id is null or repeated. A candidate that confident patterns give several kinds has the first of them in the order of ``KINDS``.
All base patterns are searched with anchors that make them linear in the text's length, and a context word ends where the
neighbouring identifier begins, so that all contexts of a text together are read in linear time too.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calltrace.functions.work import materialize, release
from calltrace.llm.text import blocks, bounded_batches

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits that starts inside a longer run can't match where the whole run doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])(?:[(]?[0-9][0-9().-]*(?:\x20[(]?[0-9][0-9().-]*)+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*)")
_OPENS = re.compile("[0-9A-Za-z+(@]")
_GROUP = re.compile("[0-9]+")
#: A phone over any white space.
_WIDE = re.compile(r"\+[0-9][\x20\x09-\x0D().0-9-]+[0-9]")
_CLOSES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_GAP = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
#: Longer context words are named by their hash.
_NAMED = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = m.end()
            yield start, done


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind as in :data:`KINDS`, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in (q.lstrip("0") for q in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def fits(token: str) -> str:
    """The kinds that a token could be, comma-joined: the base patterns without their strictest parts."""
    digits = sum(c.isdigit() for c in token)
    parts = re.split(r"[.:,]", token)
    could = {
        "email": "@" in token.strip("@") or "(at)" in token.lower(),
        "ip": len(parts) == 4 and all(p.isdigit() and len(p) <= 3 for p in parts),
        "card": 12 <= digits <= 19 and not re.search("[A-Za-z@]", token),
        "phone": 7 <= digits <= 15 and not re.search("[A-Za-z@]", token),
    }
    return ",".join(k for k in KINDS if could[k])


def instance(token: str, could: str) -> bytes:
    """Key of the identifier that a token names: in lower case, numbers but addresses by their digits."""
    plain = "".join(c for c in token if c.isdigit()) if could in ("card", "phone", "card,phone") else token.lower()
    return hashlib.blake2b(f"{could}:{plain}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def form(token: str) -> str:
    """An identifier's own form, with the check of card digits."""
    digits = "".join(c for c in token if c in "0123456789")
    checked = ("+luhn" if luhn(digits) else "-luhn") if 16 <= len(digits) <= 19 and not re.search("[A-Za-z@]", token) else ""
    return _named(re.sub("[^\\W\\d_]+", "a", re.sub("[0-9]", "9", re.sub("[\\x20\\x09-\\x0D]+", " ", token))) + checked)


def _named(word: str) -> str:
    word = word.lower()
    return word if len(word) <= _NAMED else "#" + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _bare(word: str) -> str:
    """A context word without outer punctuation."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return _named(word[a:b])


def _around(text: str, spans: list[tuple[int, int]], most: int) -> list[tuple[list[str], list[str]]]:
    """For each span up to ``most`` words before and after it, the nearest first; none beyond a neighbouring span."""
    starts, ends = sorted(s for s, _ in spans), sorted(e for _, e in spans)
    out = []
    for s, e in spans:
        at = bisect_right(ends, s)
        low = ends[at - 1] if at else 0
        before, b = [], s
        while len(before) < most:
            while b > low and text[b - 1] in _GAP:
                b -= 1
            if b == low:
                break
            a = b
            while a > low and text[a - 1] not in _GAP:
                a -= 1
            before.append(_bare(text[a:b]))
            b = a
        at = bisect_left(starts, e)
        high = starts[at] if at < len(starts) else len(text)
        after, c = [], e
        while len(after) < most:
            while c < high and text[c] in _GAP:
                c += 1
            if c == high:
                break
            d = c
            while d < high and text[d] not in _GAP:
                d += 1
            after.append(_bare(text[c:d]))
            c = d
        out.append((before, after))
    return out


def contexts(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """For each span the word before and the word after it; empty at a text's ends and where another span comes first."""
    return [((before or [""])[0], (after or [""])[0]) for before, after in _around(text, spans, 1)]


def patterns_of(text: str, spans: list[tuple[int, int]]) -> list[list[tuple[str, str]]]:
    """For each span the patterns it meets: ``(side, words)`` and its form."""
    out = []
    for (s, e), (before, after) in zip(spans, _around(text, spans, 2), strict=True):
        own = [("form", form(text[s:e]))]
        for side, words in (("before", before), ("after", after)):
            if words and words[0]:
                own.append((side, words[0]))
                if len(words) == 2 and words[1]:
                    own.append((side, f"{words[1]} {words[0]}" if side == "before" else f"{words[0]} {words[1]}"))
        out.append(own)
    return out


def cut_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What base matches that failed may hold: single card numbers, or four groups of four, with a right check digit; phones over other white space."""
    taken = sorted((s, e) for _, s, e in base)
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 17 or len(groups := list(_GROUP.finditer(text, *m.span()))) < 2:
            continue
        k = 0
        while k < len(groups):
            for n in (1, 4):
                part = groups[k : k + n]
                digits = "".join(g.group() for g in part)
                if len(part) == n and (n == 1 and 16 <= len(digits) <= 19 or n == 4 and all(len(g.group()) == 4 for g in part)) and luhn(digits):
                    out.append((part[0].start(), part[-1].end()))
                    k += n - 1
                    break
            k += 1
    if "+" in text:
        out += [m.span() for m in _WIDE.finditer(text) if re.search("[\\x09-\\x0D]", m.group()) and 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    kept, last = [], 0
    for s, e in sorted(out):
        at = bisect_left(taken, (s,))
        if s >= last and not (at < len(taken) and taken[at][0] < e) and not (at and taken[at - 1][1] > s):
            kept.append((s, e))
            last = e
    return kept


def candidate_spans(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens, without outer punctuation, that touch no span of ``taken``."""
    bounds = sorted((s, e) for _, s, e in taken)
    at = 0
    for m in _CANDIDATE.finditer(text):
        first, e = _OPENS.search(text, *m.span()), m.end()
        if not first:
            continue
        s = first.start()
        while e > s and text[e - 1] not in _CLOSES:
            e -= 1
        if e < s + 2:
            continue
        while at < len(bounds) and bounds[at][1] <= s:
            at += 1
        if at < len(bounds) and bounds[at][0] < e:
            continue
        if any(c in "0123456789@" for c in text[s:e]):
            yield s, e


_MET = pa.list_(pa.struct([("side", pa.string()), ("word", pa.string())]))
_MENTIONS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("met", _MET), ("fits", pa.string()), ("instance", pa.binary())])


def found_in(text: str) -> list[tuple]:
    """``(kind, start, end, met, fits, instance)`` of a text's base spans and, with no kind, of its candidates."""
    base = base_spans(text)
    cut = cut_spans(text, base)
    found = [*base, *((None, s, e) for s, e in cut), *((None, s, e) for s, e in candidate_spans(text, [*base, *((None, s, e) for s, e in cut)]))]
    out = []
    for (kind, s, e), met in zip(found, patterns_of(text, [x[1:] for x in found]), strict=True):
        could = fits(text[s:e])
        out.append((kind, s, e, met, could, instance(text[s:e], could)))
    return out


def _mentions(batches):
    """All that :func:`found_in` finds; one row without a span for a text that has none."""
    for block in blocks(batches):
        rows = []
        for row, doc_id, text in zip(*(block.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
            found = found_in(text or "")
            rows += [(row, doc_id, kind, s, e, [{"side": a, "word": w} for a, w in met], could, key) for kind, s, e, met, could, key in found]
            if not found:
                rows.append((row, doc_id, "", 0, 0, [], "", None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MENTIONS, strict=True)], schema=_MENTIONS)


def mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All mentions, with the number ``row`` of the input row that holds them; write it before it is read twice."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _mentions, "row long, doc_id long, kind string, start int, end int, met array<struct<side:string,word:string>>, fits string, instance binary"
    )


def confident_patterns(found: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """``(side, word, kind)``: patterns whose distinct instances are known ones of one kind.

    ``found`` comes from :func:`mentions`. In each round a pattern's confidence for a
    kind is its known instances / all its instances; those with at least ``support`` known instances and at least
    ``confidence`` make every candidate they meet that fits the kind an instance of it, which counts as known in all its
    contexts from then on. Rounds end early when one adds no instance.
    """
    met = found.where("kind IS NULL OR kind <> ''").select(F.explode("met").alias("p"), "instance", "fits", "kind")
    graph = materialize(met.select("p.side", "p.word", "instance", "fits", "kind").distinct(), "pii-graph")
    totals = materialize(graph.select("side", "word", "instance").distinct().groupBy("side", "word").agg(F.count("*").alias("all")), "pii-totals")
    seeds = graph.where("kind IS NOT NULL").select("side", "word", "instance", "kind")
    loose = graph.where("kind IS NULL AND fits <> ''").select("side", "word", "instance", "fits")
    fit = F.array_contains(F.split("fits", ","), F.col("kind"))
    known = materialize(found.where("kind <> ''").where(fit).select("instance", "kind").distinct(), "pii-known")
    size, used = known.count(), [graph, totals, known]
    for _ in range(rounds):
        held = seeds.unionByName(loose.where("side <> 'form'").join(known, "instance").select("side", "word", "instance", "kind")).distinct()
        good = held.groupBy("side", "word", "kind").agg(F.count("*").alias("known")).join(totals, ["side", "word"])
        good = materialize(good.where((F.col("known") >= support) & (F.col("known") >= confidence * F.col("all"))).select("side", "word", "kind"), "pii-good")
        known = materialize(known.unionByName(loose.join(good, ["side", "word"]).where(fit).select("instance", "kind")).distinct(), "pii-known")
        size, before = known.count(), size
        used += [good, known]
        if size == before:
            break
    release(*(u for u in used if u is not good))
    return good


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **scoring) -> DataFrame:
    """``(doc_id, base, spans)`` per input row: arrays of ``(rank, start, end, kind)``, sorted; ``spans`` holds base spans and those the patterns add."""
    found = materialize(mentions(docs, doc_id, text), "pii-mentions")
    patterns = confident_patterns(found, **scoring)
    loose = found.where("kind IS NULL AND fits <> ''").select("row", "doc_id", "start", "end", "fits", F.explode("met").alias("p"))
    added = loose.select("row", "doc_id", "start", "end", "fits", "p.side", "p.word").join(patterns, ["side", "word"]).where(F.array_contains(F.split("fits", ","), F.col("kind")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    added = added.groupBy("row", "doc_id", "start", "end").agg(F.min_by("kind", rank).alias("kind"))
    span = F.struct(rank.alias("rank"), "start", "end", "kind")
    none = F.lit(None).cast("struct<rank:bigint,start:int,end:int,kind:string>")
    every = found.select("row", "doc_id", F.when(F.col("kind") != "", span).alias("base"), none.alias("extra")).union(added.select("row", "doc_id", none, span))
    out = every.groupBy("row", "doc_id").agg(F.array_sort(F.collect_set("base")).alias("base"), F.array_sort(F.array_union(F.collect_set("base"), F.collect_set("extra"))).alias("spans"))
    return out.drop("row")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
