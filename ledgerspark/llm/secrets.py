"""Secret scans through a trigram inverted index, in DataFrame functions only.

Every rule's regex is turned into a Boolean query over trigrams that any match must contain. The index holds postings
``(trigram, document)`` for the trigrams that rules ask for; intersecting them gives the candidates, and only those are
read by the regex. Rules without mandatory trigrams read every text.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import stored, text_hash, text_of, unused

#: Trigrams held in one posting mask.
MASK_BITS = 62


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length counts, and its least length in code points; shorter matches are dropped.
    group: int = 0
    least: int = 1


#: The three base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

#: Further well-known forms of keys.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams, one of which every match contains whole; None if a match may have none."""

    def alternatives(nodes) -> list[tuple[frozenset[str], str, str, bool]]:
        """``(trigrams, text at the start, text at the end, exact)`` of each way to match; exact: it is that text alone."""
        ways = [(frozenset(), "", "", True)]
        for kind, value in nodes:
            ways = [_then(a, b) for a in ways for b in step(kind, value)]
            if len(ways) > 64:
                ways = [(g, "", "", False) for g, _, _, _ in ways]
                common = frozenset.intersection(*(w[0] for w in ways))
                ways = [(common, "", "", False)]
        return ways

    def step(kind, value):
        if kind is sre.LITERAL:
            return [(frozenset(), chr(value).lower(), chr(value).lower(), True)]
        if kind is sre.SUBPATTERN:
            return alternatives(value[-1])
        if kind is sre.BRANCH:
            return [way for branch in value[1] for way in alternatives(branch)]
        if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            if (least, most) == (0, 1):
                return [(frozenset(), "", "", True), *alternatives(inner)]
            if least:
                return [(g, s, e, False) for g, s, e, _ in alternatives(inner)]
        if kind is sre.AT:
            return [(frozenset(), "", "", True)]
        return [(frozenset(), "", "", False)]

    def _then(a, b):
        grams = a[0] | b[0] | _grams(a[2] + b[1])
        start = a[1] + b[1] if a[3] else a[1]
        end = a[2] + b[2] if b[3] else b[2]
        return grams, start, end, a[3] and b[3]

    def _grams(text: str) -> frozenset[str]:
        return frozenset(text[i : i + 3] for i in range(len(text) - 2))

    found = {g | _grams(s) | _grams(e) for g, s, e, _ in alternatives(sre_parse.parse(pattern))}
    if frozenset() in found:
        return None
    return sorted((g for g in found if not any(other < g for other in found)), key=sorted)


def _bits(grams: list[str], wanted: frozenset[str] | str) -> list[int]:
    """One mask for every ``MASK_BITS`` trigrams of ``grams``."""
    masks = [0] * -(-len(grams) // MASK_BITS)
    for i, gram in enumerate(grams):
        if gram == wanted or (not isinstance(wanted, str) and gram in wanted):
            masks[i // MASK_BITS] |= 1 << i % MASK_BITS
    return masks


def build_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings ``(trigram, doc_id, text_key)``; trigrams are looked for in lower-cased text."""
    low = docs.select("doc_id", text_hash().alias("text_key"), F.lower(text_of()).alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return low.select(F.explode(held).alias("trigram"), "doc_id", "text_key")


def intersect(postings: DataFrame, grams: list[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """``(doc_id, text_key, kinds)``: rules of which some alternative has postings for all its trigrams in the document."""
    wide = range(-(-len(grams) // MASK_BITS))
    bit = [
        F.coalesce(*[F.when(F.col("trigram") == g, F.lit(_bits(grams, g)[m])) for g in grams], F.lit(0)).cast("long")
        for m in wide
    ]
    seen = postings.groupBy("doc_id", "text_key").agg(*[F.bit_or(bit[m]).alias(f"m{m}") for m in wide])

    def holds(clause: frozenset[str]) -> Column:
        test = F.lit(True)
        for m, mask in enumerate(_bits(grams, clause)):
            test = test & (F.col(f"m{m}").bitwiseAND(F.lit(mask)) == mask)
        return test

    def any_of(clauses: list[frozenset[str]]) -> Column:
        test = F.lit(False)
        for clause in clauses:
            test = test | holds(clause)
        return test

    kinds = F.filter(F.array(*[F.when(any_of(q), F.lit(kind)) for kind, q in queries.items()]), lambda k: k.isNotNull())
    return seen.select("doc_id", "text_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _matches(rule: Rule) -> Column:
    """Matches of one rule as ``array<struct<i, kind, gap, size, counted>>``; gap: code points since the match before."""
    text = text_of()
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.slice(F.split(text, rule.pattern), 1, F.size(whole))
    zipped = F.arrays_zip(between.alias("gap"), whole.alias("whole"), part.alias("part"))
    made = F.transform(
        zipped,
        lambda z, i: F.struct(
            i.alias("i"),
            F.lit(rule.kind).alias("kind"),
            F.char_length(z["gap"]).alias("gap"),
            F.char_length(z["whole"]).alias("size"),
            F.char_length(z["part"]).alias("counted"),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), made).otherwise(F.array().cast("array<struct<i:int,kind:string,gap:int,size:int,counted:int>>"))


def _thinned(rule: Rule) -> Rule:
    """The same rule reading only long runs where that cannot change what it finds: a run of one class is matched whole or not."""
    run = re.fullmatch(r"(?P<head>\w*)(?P<run>\[[^\]]+\])\+", rule.pattern)
    if not run or rule.group or rule.least <= len(run["head"]):
        return rule
    inside = re.compile(run["run"])
    if not all(inside.fullmatch(c) for c in run["head"]):
        return rule
    return Rule(rule.kind, f"{run['head']}{run['run']}{{{rule.least - len(run['head'])},}}", 0, rule.least)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """``(doc_id, text_key, kind, start, stop)``: every match, leftmost non-overlapping per rule, in code points, end exclusive.

    A text_key is the hash of the text, so rows with one doc_id and other texts stay apart; rows repeated whole give their
    spans once. Null text counts as empty. Matches whose counted group is too short are dropped after they were taken.
    """
    rules = tuple(_thinned(r) for r in rules)
    asked = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in asked.items() if q is not None}
    base = docs.select("doc_id", "text", text_hash().alias("text_key"))
    found = []
    for rule in rules:
        if rule.kind not in indexed:
            found.append(base.select("doc_id", "text_key", F.explode(_matches(rule)).alias("m")))
    if indexed:
        grams = sorted({g for q in indexed.values() for clause in q for g in clause})
        candidates = intersect(stored(build_index(docs, grams), "postings"), grams, indexed).select(
            F.col("doc_id").alias("cand_id"), F.col("text_key").alias("cand_key"), "kinds"
        )
        same = F.col("doc_id").eqNullSafe(F.col("cand_id")) & (F.col("text_key") == F.col("cand_key"))
        none = F.array().cast("array<struct<i:int,kind:string,gap:int,size:int,counted:int>>")
        each = [
            F.when(F.array_contains("kinds", rule.kind), _matches(rule)).otherwise(none) for rule in rules if rule.kind in indexed
        ]
        checked = base.join(candidates, same).select("doc_id", "text_key", F.explode(F.concat(*each)).alias("m"))
        found.append(checked)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("doc_id", "text_key", "m.*").dropDuplicates(["doc_id", "text_key", "kind", "i"])
    upto = Window.partitionBy("doc_id", "text_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(upto)
    least = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(r.least)) for r in rules])
    return (
        rows.select("*", stop.alias("stop"))
        .where(F.col("counted") >= least)
        .select("doc_id", "text_key", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")
    )


def scan_secrets(docs: DataFrame, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row per row of ``docs``.

    base_sha256 digests the base spans as ``kind:start:end`` by start, then kind as listed, comma-joined; spans joins all
    of them likewise. Null and empty texts have no span. Columns of ``docs`` other than doc_id and text are not read.
    """
    rules = BASE + added
    spans = secret_spans(docs, rules)
    order = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)])
    item = F.struct("start", order.alias("kind_order"), F.concat_ws(":", "kind", "start", "stop").alias("shown"))
    per_doc = spans.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        *[F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in BASE],
    )
    shown = lambda items: F.array_join(F.transform(items, lambda x: x["shown"]), ",")
    per_doc = stored(
        per_doc.select(
            F.col("doc_id").alias("span_id"),
            F.col("text_key").alias("span_key"),
            *[f"n_{r.kind}" for r in BASE],
            shown(F.filter("items", lambda x: x["kind_order"] < len(BASE))).alias("base"),
            shown(F.col("items")).alias("spans"),
        ),
        "spans",
    )
    same = F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("text_key") == F.col("span_key"))
    return (
        docs.select("doc_id", text_hash().alias("text_key"))
        .join(per_doc, same, "left")
        .select(
            "doc_id",
            *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in BASE],
            F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
            F.coalesce("spans", F.lit("")).alias("spans"),
        )
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans are replaced once. Null text stays null."""
    item = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    per_doc = stored(
        secret_spans(docs, rules)
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_list(item)).alias("_spans"))
        .select(F.col("doc_id").alias("_span_id"), F.col("text_key").alias("_span_key"), "_spans"),
        "spans",
    )
    # The stretches between spans, from the furthest end so far to the next start.
    rows = per_doc.select("*", F.posexplode("_spans").alias("_i", "_span"))
    upto = Window.partitionBy("_span_id", "_span_key").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "_span_id", "_span_key", "_i", "_span", F.coalesce(F.max("_span.stop").over(upto), F.lit(0)).alias("_done")
    )
    own_key, of_id, of_key, gaps, last = unused(docs, "own_key", "of_id", "of_key", "gaps", "last")
    gap = F.when((F.col("_span.start") >= F.col("_done")), F.struct("_i", F.col("_done").alias("a"), F.col("_span.start").alias("b")))
    cuts = rows.groupBy(F.col("_span_id").alias(of_id), F.col("_span_key").alias(of_key)).agg(
        F.array_sort(F.collect_list(gap)).alias(gaps), F.max("_span.stop").alias(last)
    )
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(own_key) == F.col(of_key))
    joined = docs.select("*", text_hash().alias(own_key)).join(stored(cuts, "gaps"), same, "left")
    pieces = F.transform(gaps, lambda g: F.substring(F.col("text"), g["a"] + 1, g["b"] - g["a"]))
    tail = F.substring(F.col("text"), F.col(last) + 1, F.char_length("text"))
    text = F.when(F.col(gaps).isNull(), F.col("text")).otherwise(F.concat_ws(mark, F.array_join(pieces, mark), tail))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


SQL = None
