"""SpotSigs fingerprints.

A spot signature is a chain: a common word (the anchor) and the two content words that follow it,
common words between them left out. Boilerplate and lists hold few common words, so signatures sit
in running prose. The set of a text's signatures is its fingerprint. Sets whose sizes alone rule a
likeness out need not meet (`length_class` tells it for single sets, the search compares sizes), and
groups of sets meet only where the bound on their likeness allows.

Signatures are DataFrame functions: a look-ahead finds overlapping chains in one pass of a text. The
search joins and groups them; the links between two blocks of sets are counted in a task with numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, id_and_text, stored
from .components import Forest, components

# Common words that serve as anchors, by language.
ANCHORS = {
    "en": "a an and are as at be by for from has in is it of on or that the this to was were with",
    "fr": "au aux de des du elle en et il la le les par pas pour que qui sur un une vi",
    "de": "als auf aus das dem den der des die ein eine im ist mit nicht sich und von zu",
    "es": "al con del el las los no para se su una y",
}
CHAIN = 2


def anchor_words() -> list[str]:
    return sorted({w for words in ANCHORS.values() for w in words.split()})


def one_of(words: list[str]) -> str:
    """A pattern of these words that reads each letter once: words that begin alike share their beginning."""
    ends = "" in words
    by_letter: dict[str, list[str]] = {}
    for w in filter(None, words):
        by_letter.setdefault(w[0], []).append(w[1:])
    if not by_letter:
        return ""
    return "(?:" + "|".join(letter + one_of(rest) for letter, rest in sorted(by_letter.items())) + ")" + "?" * ends


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the distinct spot signatures of a text column as ascending 48-bit hashes, in a column of that name.

    Words are runs of letters and digits, in lower case. Where no chain is found (no anchor, or too few
    words after it), each word serves as anchor of the word after it; a text of one word has that word
    as its only signature, and a text without words the signature of the empty text, so that equal
    texts have equal sets and no set is empty.

    A text is read as runs of anchors, each with the next one or two content words; all anchors of a
    run share these. Where an anchor stands between the two, the second is the first one of the next
    run. A full stop stands after the last word, so that every run has a word after it: each is taken at
    once and never searched again, and work is in proportion to the text. Words and runs are columns of their own on the way, for an expression that several others hold would be
    computed anew for each.
    """
    words, runs, first, second = (fresh(df, n) for n in ("words_", "runs_", "first_", "second_"))
    anchor = one_of(anchor_words())
    run = rf"(?<![^ ])((?:{anchor} )++)([^ ]++) (?:(?!{anchor} )([^ ]++) )?+"
    out = df.withColumn(words, F.concat(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" . ")))
    for column, group in ((runs, 1), (first, 2), (second, 3)):
        out = out.withColumn(column, F.regexp_extract_all(F.col(words), F.lit(run), F.lit(group)))
    hashed = lambda *parts: F.shiftrightunsigned(F.xxhash64(*parts), 16)

    def chains(anchors: Column, i: Column) -> Column:
        one, two = F.get(F.col(first), i), F.get(F.col(second), i)
        two = F.when(two == "", F.get(F.col(first), i + 1)).otherwise(two)
        each = F.transform(F.array_distinct(F.split(F.rtrim(anchors), " ")), lambda a: hashed(a, one, two))
        return F.when((one != ".") & (two != "."), each).otherwise(F.array().cast("array<bigint>"))

    apart, found = fresh(df, "apart_"), fresh(df, "found_")
    out = out.withColumn(found, F.flatten(F.transform(runs, chains))).withColumn(apart, F.when(F.size(found) == 0, F.split(F.expr(f"left({words}, length({words}) - 3)"), " ")))
    pairs = F.transform(F.slice(apart, 1, F.size(apart) - 1), lambda w, i: hashed(w, F.get(F.col(apart), i + 1)))
    sigs = F.when(F.size(found) > 0, F.col(found)).when(F.size(apart) > 1, pairs).otherwise(F.array(hashed(F.get(apart, F.lit(0)))))
    return out.withColumn(name, F.array_sort(F.array_distinct(sigs))).drop(words, runs, first, second, apart, found)


def fingerprint(sigs: Column) -> Column:
    """The set itself as a string: its members ascending, 12 hexadecimal digits each. Equal sets alone have equal strings, and any two can be compared later."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.lower(F.hex(s)), 12, "0")), "")


def members(print_: Column) -> Column:
    """The set that a fingerprint holds."""
    digits = F.regexp_extract_all(print_, F.lit("[0-9a-f]{12}"), F.lit(0))
    return F.transform(digits, lambda d: F.conv(d, 16, 10).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets; sets of equal digests need no merge, disjoint ones are 0."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(a == b, F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def length_class(sigs: Column, threshold: float = 0.8) -> Column:
    """Class of a set by its size n: sets of likeness `threshold` lie in the same class or in neighbouring ones."""
    return F.floor(F.log(F.size(sigs).cast("double")) / -math.log(threshold) + 1e-9)


#: Frequent signatures that are looked up in every set, and counters that find them.
FREQUENT, COUNTERS = 2_000, 20_000


def frequent_signatures(sets: DataFrame) -> list[int]:
    """The signatures that most sets hold, the most frequent last: FREQUENT at most, whatever the input, counted over all sets in bounded memory."""
    found = sets.select(F.explode("sigs").alias("sig")).agg(F.expr(f"approx_top_k(sig, {FREQUENT}, {COUNTERS})").alias("top")).first()["top"]
    return [r["item"] for r in sorted(found or [], key=lambda r: (r["count"], r["item"])) if r["count"] > 1]


#: Most Jaccard distance to its representative at which a set is put beside it, and how many signatures at either end name the sets that may be.
RADIUS, ENDS = 0.02, 3


def gathered(sets: DataFrame, radius: float = RADIUS) -> DataFrame:
    """id, rep, apart: for sets that lie within `radius` of a representative, in Jaccard distance; a representative is not listed under itself.

    Sets whose lowest ENDS signatures are the same, then those left whose highest are, are held against one of them: a row a set in
    each round, however many there are. A set that finds no representative stays alone, which costs time only.
    """
    # a set of fewer signatures than 1 / radius has no other set so near
    large = sets.where(F.size("sigs") >= max(1 / radius, ENDS)).select("id", "sigs")
    placed, left = None, large.withColumn("head", F.lit(False))
    for key in (F.slice("sigs", 1, ENDS), F.slice("sigs", -ENDS, ENDS)):
        keyed = left.select("id", "head", key.alias("ends"))
        one = keyed.groupBy("ends").agg(F.min(F.struct(~F.col("head"), "id"))["id"].alias("rep"), F.count("*").alias("n")).where("n > 1").select("ends", "rep")
        # stored, so that where they are few no set is shuffled to find them
        others = stored(keyed.where("NOT head").join(one, "ends").where("id <> rep").select("id", "rep"), "spot-beside")
        of_rep = only(large, others, "rep").select(F.col("id").alias("rep"), F.col("sigs").alias("rep_sigs"))
        apart = 1 - likeness(F.col("sigs"), F.col("rep_sigs"))
        near = others.join(large, "id").join(of_rep, "rep").select("id", "rep", apart.alias("apart")).where(F.col("apart") <= radius)
        found = stored(near, "spot-gathered")
        placed = found if placed is None else placed.unionByName(found)
        heads = placed.select(F.col("rep").alias("id")).distinct().withColumn("is_head", F.lit(True))
        left = large.join(placed.select("id"), "id", "left_anti").join(heads, "id", "left").select("id", "sigs", F.coalesce("is_head", F.lit(False)).alias("head"))
    return placed


def only(sets: DataFrame, wanted: DataFrame, name: str = "id") -> DataFrame:
    """The sets whose id stands in a stored table's column: where that is small it goes to every task, and no other set is shuffled later."""
    return sets.join(wanted.select(F.col(name).alias("id")), "id", "left_semi")


#: Sets and signatures that one block holds, and columns of signatures that are multiplied at once.
BLOCK_SETS, BLOCK_SIGNATURES, COLUMNS = 512, 250_000, 4_096

#: What a task returns about a block: kind 0: n links of a; 1: a and b are linked; 2: a, of group n, may hold sets near some of group b.
FOUND = "kind int, a long, b long, n long"


def leading(heads: DataFrame, radii: DataFrame, threshold: float, lowest: float) -> DataFrame:
    """id, n, radius, at, wide, sig: the leading signatures of each set, of those that other sets hold as well.

    Of a set's n signatures the first n - ceil(lowest * n) + 1 lead, the rarest first. The most frequent are looked up and stand
    last; all others meet once by signature, where those that one set alone holds are left out: no other set can share
    them, yet they take the first places. `wide` are those beyond the leading ones at the threshold itself.
    """
    slack, frequent = 1e-9, F.lit(frequent_signatures(heads)).cast("array<bigint>")
    first = lambda t: (F.col("n") - F.ceil(F.lit(t) * F.col("n") - slack) + 1).cast("int")
    rest = heads.select("id", F.explode(F.array_except("sigs", frequent)).alias("sig"))
    rest = rest.withColumn("held", F.count("*").over(Window.partitionBy("sig"))).where("held > 1")
    rest = rest.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("held", "sig")))["sig"].alias("rest"))
    each = heads.select("id", F.size("sigs").alias("n"), F.array_intersect(frequent, F.col("sigs")).alias("often")).join(rest, "id", "left").join(radii, "id")
    each = each.select("id", "n", "radius", F.concat(F.coalesce("rest", F.array().cast("array<bigint>")), "often").alias("shared")).withColumn("lone", F.col("n") - F.size("shared"))
    each = each.where(first(lowest) > F.col("lone")).select("id", "n", "radius", "lone", F.posexplode(F.slice("shared", 1, first(lowest) - F.col("lone"))).alias("place", "sig"))
    return each.withColumn("at", F.col("lone") + F.col("place")).withColumn("wide", F.col("at") >= first(threshold)).select("id", "n", "radius", "at", "wide", "sig")


def meetings(lead: DataFrame, threshold: float) -> DataFrame:
    """id, n, label, other: each set with the groups in which a leading signature, sizes and places leave room for near sets.

    The group of a set is the smallest id that stands with it under a leading signature, so that copies of a text share one. Under a signature
    a set meets the groups there, not their sets: a row a group it may have links to, however large that is.
    """
    slack = 1e-9
    lowest = lead.groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("held")).where("held > 1").select("sig", "least")
    lead = stored(lead.join(lowest, "sig"), "spot-lead")
    led = lead.drop("least").join(lead.groupBy("id").agg(F.min("least").alias("label")), "id")
    groups = led.groupBy("sig", F.col("label").alias("other")).agg(
        F.count("*").alias("held"), F.min("n").alias("n_least"), F.max("n").alias("n_most"), F.max(F.col("n") - F.col("at")).alias("reach"), F.max("radius").alias("radius_other"), F.min("wide").alias("all_wide")
    )
    like = F.lit(threshold) - F.col("radius") - F.col("radius_other")
    # what the set and one of the group can share at most, from the common signature on
    reach = F.least(F.col("n") - F.col("at"), F.col("reach"))
    room = (F.col("n_most") >= like * F.col("n") - slack) & (F.col("n") >= like * F.col("n_least") - slack) & (reach * (1 + like) >= like * (F.col("n") + F.col("n_least")) - slack)
    # beyond its leading signatures at the threshold itself, a set of its own meets such that stand for others only
    meant = (F.col("radius") + F.col("radius_other") > 0) | ~(F.col("wide") | F.col("all_wide"))
    return led.join(groups, "sig").where(room & meant).where("label <> other OR held > 1").select("id", "n", "label", "other").distinct()


def in_blocks(meeting: DataFrame) -> DataFrame:
    """id and the two blocks that each of its meetings brings together: low, low_part, high, high_part, and whether it is of the second.

    A group is cut into blocks of about BLOCK_SETS sets or BLOCK_SIGNATURES signatures by hash, and each two blocks
    of groups that meet are a task. A set goes once to each block it meets, not to each of the sets there.
    """
    parts = meeting.select("id", "n", "label").distinct().groupBy("label").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SIGNATURES)).cast("int").alias("parts"))
    met = meeting.join(parts, "label").join(parts.select(F.col("label").alias("other"), F.col("parts").alias("other_parts")), "other")
    own = F.struct(F.col("label"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    met = met.select("id", own.alias("own"), "other", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)).alias("part")).withColumn("that", F.struct(F.col("other").alias("label"), "part"))
    low, high = F.least("own", "that"), F.greatest("own", "that")
    return met.select("id", low["label"].alias("low"), low["part"].alias("low_part"), high["label"].alias("high"), high["part"].alias("high_part"), (F.col("own") > F.col("that")).alias("second"))


BLOCKS = ("low", "low_part", "high", "high_part")


def _likeness_of_all(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Jaccard likeness of each set with each of the others: products of 0/1 matrices over the signatures that both sides hold."""
    sizes, other_sizes = (np.array([len(x) for x in side], np.int64) for side in (sets, others))
    held, number = np.unique(np.concatenate((*sets, *others)), return_inverse=True)
    row, split = np.repeat(np.arange(len(sets) + len(others)), np.concatenate((sizes, other_sizes))), int(sizes.sum())
    both = np.zeros(len(held), np.int8)
    both[number[:split]] |= 1
    both[number[split:]] |= 2
    place = np.where(both == 3, np.cumsum(both == 3) - 1, -1)[number]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    common = np.zeros((len(sets), len(others)), np.int64)
    for begin in range(0, int(place.max(initial=-1)) + 1, COLUMNS):
        these = slice(*np.searchsorted(place, (begin, begin + COLUMNS)))
        ones = np.zeros((len(sets) + len(others), min(COLUMNS, int(place.max()) + 1 - begin)), np.float32)
        ones[row[these], place[these] - begin] = 1
        common += (ones[: len(sets)] @ ones[len(sets) :].T).astype(np.int64)
    return common / (sizes[:, None] + other_sizes - common)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    parts = [x for chunk in column.chunks for x in np.split(chunk.flatten().to_numpy(zero_copy_only=False), np.cumsum(chunk.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(chunk)]
    return parts


def _found(kind: int, a, b, n) -> pa.Table:
    a, b, n = (np.asarray(x, np.int64) for x in np.broadcast_arrays(a, b, n))
    return pa.table({"kind": pa.array(np.full(len(a), kind, np.int32)), "a": pa.array(a), "b": pa.array(b), "n": pa.array(n)})


def _linked(vertex: np.ndarray, other: np.ndarray, near: np.ndarray) -> pa.Table:
    """Of all links between two lists of vertices, as many as connect the same ones."""
    i, j = np.nonzero(near)
    names, number = np.unique(np.concatenate((vertex, other)), return_inverse=True)
    x, y = number[: len(vertex)][i], number[len(vertex) :][j]
    new = Forest(len(names)).added(x, y)
    return _found(1, names[x[new]], names[y[new]], 0)


def _counted(ids: np.ndarray, weights: np.ndarray, other_ids: np.ndarray, other_weights: np.ndarray, near: np.ndarray) -> list[pa.Table]:
    sums = [(ids, near @ other_weights), (other_ids, near.T @ weights)]
    return [_found(0, who[n > 0], 0, n[n > 0]) for who, n in sums]


def _of_cores(threshold: float, slack: float, like: np.ndarray, radius: np.ndarray, other_radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sets of two representatives are all near one another, and where some may be, told by the likeness of the two and their radii."""
    radii = radius[:, None] + other_radius
    alone = radii == 0
    sure = np.where(alone, like >= threshold, 1 - like + radii <= 1 - threshold - slack)
    return sure, ~alone & ~sure & (like >= threshold - radii - slack)


def block_links(threshold: float, slack: float):
    """For two blocks of representatives: links whose sets are near for sure, counted, and meetings of groups where sets must be compared."""

    def run(table: pa.Table) -> pa.Table:
        second = table["second"].to_numpy()
        a, b = (~second).nonzero()[0], second.nonzero()[0]
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        same = low == high and table["low_part"][0] == table["high_part"][0]
        b = a if same else b
        out = [_found(0, [], [], [])]
        if len(a) and len(b):
            ids, weight, radius, sets = (table["id"].to_numpy(), table["weight"].to_numpy(), table["radius"].to_numpy(), _sets(table["sigs"]))
            sure, may = _of_cores(threshold, slack, _likeness_of_all([sets[k] for k in a], [sets[k] for k in b]), radius[a], radius[b])
            if same:  # a pair once, and no set with itself
                sure, may = (x & (ids[a][:, None] < ids[b]) for x in (sure, may))
            out += [*_counted(ids[a], weight[a], ids[b], weight[b], sure), _linked(ids[a], ids[b], sure)]
            out += [_found(2, ids[a][may.any(1)], high, low), _found(2, ids[b][may.any(0)], low, high)]
        return pa.concat_tables(out)

    return run


def block_single_links(threshold: float, slack: float):
    """For two blocks of sets beside representatives: near ones, where the representatives leave it open."""

    def run(table: pa.Table) -> pa.Table:
        second = table["second"].to_numpy()
        a, b = (~second).nonzero()[0], second.nonzero()[0]
        same = table["low"][0] == table["high"][0] and table["low_part"][0] == table["high_part"][0]
        b = a if same else b
        out = [_found(0, [], [], [])]
        if len(a) and len(b):
            ids, rep, copies, radius, sets, rep_sets = (table["id"].to_numpy(), table["rep"].to_numpy(), table["copies"].to_numpy(), table["radius"].to_numpy(), _sets(table["sigs"]), _sets(table["rep_sigs"]))
            (_, first_a, rep_a), (_, first_b, rep_b) = (np.unique(rep[x], return_index=True, return_inverse=True) for x in (a, b))
            first_a, first_b = a[first_a], b[first_b]
            _, may = _of_cores(threshold, slack, _likeness_of_all([rep_sets[k] for k in first_a], [rep_sets[k] for k in first_b]), radius[first_a], radius[first_b])
            may = (may & (rep[first_a][:, None] != rep[first_b]))[rep_a][:, rep_b]
            if same:
                may &= ids[a][:, None] < ids[b]
            if may.any():
                near = may & (_likeness_of_all([sets[k] for k in a], [sets[k] for k in b]) >= threshold)
                out += [*_counted(ids[a], copies[a], ids[b], copies[b], near), _linked(rep[a], rep[b], near)]
        return pa.concat_tables(out)

    return run


def near_groups(docs: DataFrame, threshold: float = 0.8, radius: float = RADIUS) -> DataFrame:
    """doc_id, class_id, n_links: a row for each row of `docs`.

    n_links counts the other rows whose set has a likeness of `threshold` or more, copies included;
    class_id is the smallest doc_id that such links reach, the row's own included. Rows without a doc_id
    take the class and links of their set, or null and 0 where no numbered row has that set; they connect no
    others and are not counted. Rows that share a doc_id are rows of their own. A null text is the empty text;
    an empty table gives an empty one. Other columns are not read.

    Equal sets are one vertex. Sets within `radius` of one representative are near one another, for Jaccard distance
    keeps to the triangle inequality, so that they are counted and not paired; representatives and sets of their own then meet by
    their leading signatures (`leading`): of a set's n in a fixed
    order, the first n - ceil(t * n) + 1 must hold one that the other's leading ones hold too, where t is
    `threshold`, lowered by both radii where a representative stands for others.
    Sets that share leading ones are groups; a set is sent to the groups that it may have links to, in blocks, and a
    task counts the links between two blocks and hands on a sum for each set and as many links as connect them. No table holds a row a pair.
    Where the distance of two representatives and the radii tell that all of their sets are near, links are sums; only
    where they leave it open are the sets compared one by one, in blocks as well. Any order and any choice of representatives is exact, so
    frequent signatures may be counted approximately. Links to copies are sums.
    """
    slack, radius = 1e-9, min(radius, threshold / 4, (1 - threshold) / 4)
    signed = with_signatures(id_and_text(docs), "text", "sigs")
    known = stored(signed.select("doc_id", F.md5(fingerprint(F.col("sigs"))).alias("key"), "sigs"), "spots")
    sets = stored(known.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("sigs").alias("sigs")).withColumn("id", F.monotonically_increasing_id()), "spot-sets")
    placed = gathered(sets, radius)
    member = sets.select("key", "id", "low", "copies", F.size("sigs").alias("n")).join(placed, "id", "left").select("key", "id", "low", "copies", "n", F.coalesce("rep", "id").alias("rep"), F.coalesce("apart", F.lit(0.0)).alias("apart"))
    member = stored(member, "spot-members")
    cores = stored(member.groupBy("rep").agg(F.sum("copies").alias("weight"), F.max("apart").alias("radius"), F.min("low").alias("low")), "spot-cores")
    heads = sets.join(placed.select("id"), "id", "left_anti").select("id", "sigs")
    core = cores.select(F.col("rep").alias("id"), "weight", "radius")

    # representatives and sets of their own that may hold near sets
    meeting = stored(meetings(leading(heads, core.select("id", "radius"), threshold, threshold - 2 * radius), threshold), "spot-meetings")
    blocks = in_blocks(meeting).join(only(core, meeting), "id").join(only(heads, meeting), "id")
    close = stored(blocks.groupBy(*BLOCKS).applyInArrow(block_links(threshold, slack), FOUND), "spot-links")

    # where that is open, sets of the two sides
    may = stored(close.where("kind = 2").select(F.col("a").alias("rep"), F.col("n").alias("label"), F.col("b").alias("other")).distinct(), "spot-may")
    meeting = stored(member.select("id", "rep", "copies", "n").join(may, "rep"), "spot-open")
    of_rep = only(core, may, "rep").join(only(heads, may, "rep"), "id").select(F.col("id").alias("rep"), "radius", F.col("sigs").alias("rep_sigs"))
    single = in_blocks(meeting).join(meeting.select("id", "rep", "copies").distinct(), "id").join(only(sets.select("id", "sigs"), meeting), "id").join(of_rep, "rep")
    singly = stored(single.groupBy(*BLOCKS).applyInArrow(block_single_links(threshold, slack), FOUND), "spot-single-links")

    sums = lambda df, name, n: df.where("kind = 0").groupBy(F.col("a").alias(name)).agg(F.sum("n").alias(n))
    roots = components(close.unionByName(singly).where("kind = 1").select("a", "b"))
    vertices = cores.join(sums(close, "rep", "n_core"), "rep", "left").join(roots, F.col("rep") == F.col("vertex"), "left").select("rep", F.coalesce("root", "rep").alias("root"), "low", (F.col("weight") + F.coalesce("n_core", F.lit(0))).alias("reached"))
    vertices = vertices.join(vertices.groupBy("root").agg(F.min("low").alias("class_id")), "root").select("rep", "class_id", "reached")
    named = member.select("key", "id", "rep").join(vertices, "rep").join(sums(singly, "id", "n_set"), "id", "left").select("key", "class_id", (F.col("reached") + F.coalesce("n_set", F.lit(0))).alias("reached"))
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(1)
    return known.select("doc_id", "key").join(named, "key", "left").select("doc_id", "class_id", (F.coalesce("reached", F.lit(0)) - own).cast("long").alias("n_links"))


def _cell(bounds: list[int], number: Column, per: int = 256) -> Column:
    """How many of these ascending bounds lie below a number: first among every `per`-th of them, then among those between two such."""
    coarse, fine = bounds[per - 1 :: per], [bounds[k : k + per] for k in range(0, len(bounds), per)] or [[]]
    below = lambda known: F.size(F.filter(known, lambda b: b < number))
    group = below(F.lit(coarse).cast("array<bigint>"))
    return F.coalesce(group * per + below(F.get(F.lit([*fine, []]).cast("array<array<bigint>>"), group)), F.lit(0))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, sigs, next_text, next_sigs: each document beside the next by doc_id, the last beside the first.

    Quantiles of doc_id cut the table into ranges, each a window of its own and all dealt out by range. The
    first row of a range stands at the end of the range before it as well, a row a range, so that a row finds its
    next one in its own range and texts are shuffled once.
    """
    known = id_and_text(docs)
    bounds = sorted({int(b) for b in known.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)})
    placed = known.select("doc_id", "text", _cell(bounds, F.col("doc_id")).alias("cell"), F.lit(False).alias("is_head"))
    heads = placed.groupBy("cell").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("k"), F.col("text"))).alias("head"))
    heads = heads.select(F.lag("cell").over(Window.orderBy("cell")).alias("before"), F.max("cell").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"), "head")
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), F.col("head.text").alias("text"), F.coalesce("before", "last").alias("cell"), F.lit(True).alias("is_head"))
    signed = with_signatures(placed.unionByName(heads).repartitionByRange(parts, "cell"), "text", "sigs")
    order = Window.partitionBy("cell").orderBy("is_head", F.col("doc_id").asc_nulls_first(), "text")
    follower = signed.withColumn("next", F.lead(F.struct("text", "sigs")).over(order)).where("NOT is_head")
    return follower.select("doc_id", "text", "sigs", F.col("next.text").alias("next_text"), F.col("next.sigs").alias("next_sigs"))


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures, length_class.

    The edited text is the text whose last floor(n_chars / 4) code points are replaced by the first
    as many of the next document. A null text is the empty text; rows that share a doc_id follow each
    other by text; a lone row is its own next document; an empty table gives no rows.
    """
    parts = parts or max(8, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    quarter = F.expr("length(text) div 4").cast("int")
    rows = with_next(docs, parts).withColumn("edited", F.concat(F.expr("left(text, length(text) - length(text) div 4)"), F.substring(F.col("next_text"), F.lit(1), quarter)))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
        length_class(F.col("sigs")).cast("long").alias("length_class"),
    )
