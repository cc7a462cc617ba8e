"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: alternatives, each a set of
trigrams that a match must hold. The index has a posting (trigram, document) for each of these trigrams
that a text holds; postings meet the alternatives by trigram, and a document is in the intersection
of an alternative's lists if it brings all of its trigrams. Only such documents are searched with the
rule's expression. Rules without mandatory trigrams (runs of hex digits, say) search every document.

Matches become rows, whose places are running sums over the stretches between them, so work is in
proportion to a text and its matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length.
    group: int = 0
    least: int = 1
    base: bool = False


# The base kinds, in their order, then the further ones.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("code_host", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 0, 40),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+", 0, 24),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("login_url", r"[a-z]{2,10}://[A-Za-z0-9_.-]{1,64}:[A-Za-z0-9_.%-]{1,64}@"),
)
_MOST = 32


#: Pieces of a regular expression: escapes, classes, group openings, ends, bars, quantifiers, any other character.
_PIECE = re.compile(r"\\x(?P<hex>[0-9a-fA-F]{2})|\\(?P<escape>.)|\[(?P<set>\^?(?:\\x[0-9a-fA-F]{2}|\\.|[^\]\\])+)\]|(?P<open>\((?:\?[aimsux]*:|\?<?[=!])?)|(?P<close>\))|(?P<bar>\|)|(?P<times>[*+?]|\{\d+(?:,\d*)?\})[?+]?|(?P<other>.)", re.S)
#: What an expression may be: the few strings that it can match (None: too many), and trigram sets of which a match holds one in full.
Need = tuple[set[str] | None, list[frozenset[str]]]
_ANYTHING: Need = (None, [frozenset()])


def _of_set(inside: str) -> set[str] | None:
    """The lower-case characters of a class, if they are at most eight."""
    if inside[0] == "^" or re.search(r"\\[dDwWsS]", inside):
        return None
    chars: set[str] = set()
    for m in re.finditer(r"(\\x..|\\.|.)(?:-(\\x..|\\.|.))?", inside, re.S):
        first, last = (None if c is None else ord(c) if len(c) == 1 else int(c[2:], 16) if len(c) == 4 else ord(c[1]) for c in m.groups())
        chars |= {chr(k).lower() for k in range(first, (first if last is None else last) + 1)}
    return chars if len(chars) <= 8 else None


def _trigrams(strings: set[str]) -> list[frozenset[str]]:
    found = [frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings]
    return [frozenset()] if not all(found) else list(dict.fromkeys(found))


def _both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
    return min(a, b, key=len) if len(a) * len(b) > _MOST else list(dict.fromkeys(x | y for x in a for y in b))


def _joined(parts: list[Need]) -> Need:
    """Parts in sequence: strings multiply while they are few; where a part can be anything, what was gathered must hold in full, and gathering starts anew."""
    so_far, query, whole = {""}, [frozenset()], True
    for strings, inner in parts:
        if strings is not None and len(so_far) * len(strings) <= _MOST:
            so_far = {a + b for a in so_far for b in strings}
            continue
        whole = False
        query = _both(_both(query, _trigrams(so_far)), inner if strings is None else _trigrams(strings))
        so_far = {""}
    return (so_far, query) if whole else (None, _both(query, _trigrams(so_far)))


def _either(branches: list[Need]) -> Need:
    if all(s is not None for s, _ in branches):
        return set().union(*(s for s, _ in branches)), [frozenset()]
    return None, [x for s, q in branches for x in (q if s is None else _trigrams(s))]


def _repeated(part: Need, times: str) -> Need:
    strings, query = part
    bounds = {"?": "0,1", "*": "0,", "+": "1,"}.get(times, times.strip("{}"))
    low, _, high = bounds.partition(",")
    low, high = int(low), high if "," in bounds else low
    if low == 0:
        return (strings | {""}, [frozenset()]) if high == "1" and strings is not None else _ANYTHING
    if str(low) == high and low <= 8 and strings is not None and len(strings) ** low <= _MOST:
        return _joined([part] * low)
    return None, query if strings is None else _trigrams(strings)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that must all occur; [frozenset()] where none is mandatory."""
    # a group is its branches, a branch its parts; look-arounds take no room and bring no strings
    open_groups: list[tuple[list[list[Need]], bool]] = [([[]], False)]
    for m in _PIECE.finditer(pattern):
        kind, text = m.lastgroup, m[m.lastgroup]
        branches = open_groups[-1][0]
        if kind == "open":
            open_groups.append(([[]], text.endswith(("=", "!"))))
        elif kind == "close":
            inner, looks = open_groups.pop()
            open_groups[-1][0][-1].append(({""}, [frozenset()]) if looks else _either([_joined(b) for b in inner]))
        elif kind == "bar":
            branches.append([])
        elif kind == "times":
            branches[-1][-1] = _repeated(branches[-1][-1], text)
        elif kind == "set":
            chars = _of_set(text)
            branches[-1].append(_ANYTHING if chars is None else (chars, [frozenset()]))
        elif kind == "hex":
            branches[-1].append(({chr(int(text, 16)).lower()}, [frozenset()]))
        elif kind == "escape" and text in "bBAZ" or kind == "other" and text in "^$":
            branches[-1].append(({""}, [frozenset()]))
        elif kind == "escape" and text in "dDwWsS" or kind == "other" and text == ".":
            branches[-1].append(_ANYTHING)
        else:
            branches[-1].append(({{"n": "\n", "t": "\t", "r": "\r"}.get(text, text).lower() if kind == "escape" else text.lower()}, [frozenset()]))
    strings, query = _either([_joined(b) for b in open_groups[0][0]])
    query = query if strings is None else _trigrams(strings)
    return [frozenset()] if frozenset() in query else query


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id, text_hash: a row for each of the given trigrams that a text holds, in lower case."""
    # lower case once a text: within the array each trigram would ask for it anew
    low = docs.select("doc_id", "text_hash", F.lower("text").alias("low"))
    held = F.filter(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams)), lambda t: t.isNotNull())
    return low.select(F.explode(held).alias("trigram"), "doc_id", "text_hash")


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text_hash, kinds: documents that fulfil the trigram query of a rule, and of which ones."""
    queries = [(r.kind, sorted(a)) for r in rules if (q := trigram_query(r.pattern)) != [frozenset()] for a in q]
    wanted = [(n, kind, t, 1 << k, (1 << len(a)) - 1) for n, (kind, a) in enumerate(queries) for k, t in enumerate(a)]
    if not wanted:
        return docs.select("doc_id", "text_hash", F.array().cast("array<string>").alias("kinds")).limit(0)
    # as many rows as the rules' alternatives have trigrams
    table = F.broadcast(docs.sparkSession.createDataFrame(wanted, "alternative int, kind string, trigram string, bit long, every long"))
    met = postings(docs, sorted({t for _, _, t, _, _ in wanted})).join(table, "trigram")
    whole = met.groupBy("doc_id", "text_hash", "alternative", "kind", "every").agg(F.bit_or("bit").alias("bits")).where("bits = every")
    return whole.groupBy("doc_id", "text_hash").agg(F.collect_set("kind").alias("kinds"))


def found_matches(text: Column, rule: Rule, order: int) -> Column:
    """The rule's leftmost matches that do not overlap: rank, number, code points between it and the one before, its own, and those that count."""
    pattern = F.lit(rule.pattern)
    lengths = lambda texts: F.transform(texts, lambda t: F.length(t))
    whole = lengths(F.regexp_extract_all(text, pattern, F.lit(0)))
    counted = whole if not rule.group else lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    # after the last match comes one more gap, without a match
    every = F.arrays_zip(lengths(F.split(text, rule.pattern, -1)).alias("gap"), whole.alias("whole"), counted.alias("counted"))
    return F.transform(F.filter(every, lambda x: x["whole"].isNotNull()), lambda x, i: F.struct(F.lit(order).alias("rank"), i.alias("number"), x["gap"].alias("gap"), x["whole"].alias("whole"), x["counted"].alias("counted")))


def _scanned(rule: Rule) -> Rule:
    """The same rule as a scan of every document can best run it: a run of one class that is long enough by itself."""
    if not rule.group and (m := re.fullmatch(r"(\[[^]]+\])\+", rule.pattern)):
        return Rule(rule.kind, f"{m[1]}{{{rule.least},}}", 0, rule.least, rule.base)
    return rule


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans: array of (start, rank, kind, end) by start and then the rules' order; a row for each row of `docs`.

    A null text is the empty text and has none. Rows may share a doc_id or lack one: the index knows a
    document by its doc_id and the hash of its text.
    """
    known = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    scans = {r.kind for r in rules if trigram_query(r.pattern) == [frozenset()]}
    picked = candidates(known, rules)
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    named = lambda df: df.withColumnsRenamed({"doc_id": "own_id", "text_hash": "own_hash"})
    joined = known.join(named(picked), same, "left").select("doc_id", "text_hash", "text", "kinds")
    none = F.array().cast("array<struct<rank:int,number:int,gap:int,whole:int,counted:int>>")
    each = []
    for order, rule in enumerate(rules):
        run = _scanned(rule) if rule.kind in scans else rule
        when = F.regexp_like("text", F.lit(run.pattern)) if rule.kind in scans else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        each.append(F.when(when, found_matches(F.col("text"), run, order)).otherwise(none))
    matches = joined.select("doc_id", "text_hash", F.inline(F.concat(*each)))
    # one exchange by document for the sums and the lists; repeated rows bring the same matches
    matches = matches.repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "rank", "number"])
    before = Window.partitionBy("doc_id", "text_hash", "rank").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("whole")).over(before)
    kind, least = (F.element_at(F.array(*map(F.lit, x)), F.col("rank") + 1) for x in ([r.kind for r in rules], [r.least for r in rules]))
    spans = matches.select("doc_id", "text_hash", end.alias("end"), "whole", "counted", "rank", kind.alias("kind"), least.alias("least")).where("counted >= least")
    span = F.struct((F.col("end") - F.col("whole")).alias("start"), "rank", "kind", "end")
    lists = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return known.select("doc_id", "text_hash").join(named(lists), same, "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")).alias("spans"))


def report(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 of the base spans as kind:start:end, spans as such a string."""
    base = [r.kind for r in rules if r.base]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in base]  # noqa: B023  it is called at once
    return scanned.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The report in DuckDB, which searches every text with every rule."""
    parts = []
    for order, rule in enumerate(rules):
        p = _scanned(rule).pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {order} AS rank, '{rule.kind}' AS kind, "
            "CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start, length(ms[i]) AS n "
            f"FROM (SELECT doc_id, string_split_regex(t, '{p}') AS ps, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {rule.group}) AS gs, "
            f"unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d) WHERE length(gs[i]) >= {rule.least}"
        )
    base = ", ".join(f"'{r.kind}'" for r in rules if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    line = "kind || ':' || start || ':' || (start + n)"
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(parts) + "), "
        f"g AS (SELECT doc_id, {counts}, string_agg({line}, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS own, string_agg({line}, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id) "
        "SELECT d.doc_id, " + ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base) + ", sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"
    )
