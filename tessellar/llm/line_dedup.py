"""Removal of lines that are equal to an earlier line or within a few edits of one, by a segment-partition edit join.

DataFrame functions only. Of each distinct line that isn't blank, however short, the first occurrence stands for it. Lines are
also held against each other: two of them are near if they are within one edit for every PER_EDIT characters of the shorter one, k at most. So
the bound is two edits from 20 characters on, one from 10 on, and shorter lines are near if they are equal.
With threshold k a line is cut into k + 1 segments; a line within k edits has one of them unchanged, and the position it
can have there is bounded by the edits before and after it. So each line puts its segments into an index keyed by length,
segment and content, and probes it with the few substrings that can match lines of its own length down to k less. Pairs
that meet are first held against their counts of letters, inside the join, then their texts are verified by a
bit-parallel edit distance on the band of 2k + 1 diagonals, after common ends are cut off.

A line goes if it is not the first of its equals, or if an earlier line (by doc_id, then line number) is near to
it, whether that line itself stays or not. Lines of white space alone, of fewer than BLANK characters, always stay. Lines end at a line feed. Null counts as an empty
text and stays null. Repeated rows are separate documents, in the order of (doc_id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize, release

#: Most edits; characters for each edit; characters from which lines of white space alone count as lines.
EDITS, PER_EDIT, BLANK = 2, 10, 20
#: Letters whose counts are compared: the commonest of Latin-script languages, so that most edits change one.
_LETTERS = "etanio"


def bound(chars: Column, k: int = EDITS) -> Column:
    """Edits within which a line of so many characters is near to one as long or longer."""
    return F.least(F.lit(k), F.floor(chars / PER_EDIT).cast("int"))


def index_specs(k: int = EDITS) -> list[tuple[int, int, int]]:
    """(less, segment, shift) of the k + 1 segments that a line puts into the index."""
    return [(0, i, 0) for i in range(k + 1)]


def probe_specs(k: int = EDITS) -> list[tuple[int, int, int]]:
    """(less, segment, shift) of the substrings that can equal a segment of a line shorter by less.

    i segments come before and k - i after: the shift is bounded by edits on the left and, through the difference in
    length, by those on the right.
    """
    return [(less, i, d) for less in range(k + 1) for i in range(k + 1) for d in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1)]


def keyed_segments(rows: DataFrame, specs, k: int = EDITS, own: int = 0) -> DataFrame:
    """rows (_k, tag, line, len) once for each of specs(edits) whose substring exists: _k, tag and key, a 64-bit hash.

    The edits are the bound of the line that the substring can be of. own is added to the tag where the substring is a segment of the
    line itself. Of e + 1 segments the last ones are the longer. One small expression per exploded row: fifteen of them in one row make
    a method too large to be compiled.
    """
    table = lambda edits: F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((e, *s), ("e", "less", "i", "d"))]) for e in edits for s in specs(e)])
    out = rows.select("*", F.inline(F.when(F.col("len") >= k * PER_EDIT + k, table([k])).otherwise(table(range(1, k + 1)))))
    of = F.col("len") - F.col("less")
    out = out.withColumn("of", of).where(F.col("e") == bound(F.col("of"), k))
    out = out.withColumn("longer", F.pmod("of", F.col("e") + 1)).withColumn("size", ((F.col("of") - F.col("longer")) / (F.col("e") + 1)).cast("int"))
    out = out.withColumn("over", F.col("i") - (F.col("e") + 1) + F.col("longer"))
    n, at = F.col("size") + F.when(F.col("over") >= 0, 1).otherwise(0), F.col("i") * F.col("size") + F.greatest(F.col("over"), F.lit(0)) + F.col("d")
    out = out.withColumn("n", n).withColumn("at", at).where("of >= 0 AND at >= 0 AND at + n <= len")
    tag = F.col("tag") + F.when(F.expr("less = 0 AND d = 0"), own).otherwise(0)
    return out.select("_k", tag.alias("tag"), F.xxhash64(F.substr("line", F.col("at") + 1, F.col("n")), "of", "i").alias("key"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of equal characters at the start, by halving steps."""
    most = F.least(F.char_length(a), F.char_length(b))
    steps = F.array(*[F.lit(1 << s) for s in range(29, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= most) & (F.substring(a, p + 1, s) == F.substring(b, p + 1, s)), p + s).otherwise(p))


def within(a: Column, b: Column, k: int = EDITS, edits: Column | None = None) -> Column:
    """Whether arrays of characters a and b are within k edits, or within edits, which is k at most.

    Bit d + k of mask e says that the first j + d characters of a become the first j of b by e edits or fewer. Each
    character of b turns the masks into the next ones with one comparison per diagonal and a few operations on bits.
    """
    m, n = F.size(a), F.size(b)
    full = (1 << (2 * k + 1)) - 1

    def clip(x):
        return x.bitwiseAND(F.lit(full))

    def names(values):
        return F.struct(*[v.cast("int").alias(f"f{e}") for e, v in enumerate(values)])

    start = names([F.lit(sum(1 << (d + k) for d in range(0, e + 1) if d <= k)) for e in range(k + 1)])

    def step(f, j):
        equal = F.lit(0)
        for d in range(-k, k + 1):
            equal = equal + F.when(F.get(a, j + d) == F.get(b, j), 1 << (d + k)).otherwise(0)
        new = []
        for e in range(k + 1):
            v = f[f"f{e}"].bitwiseAND(equal)
            if e:
                old = f[f"f{e - 1}"]
                v = v.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(clip(F.shiftleft(new[e - 1], 1)))
            new.append(v)
        return names(new)

    edits = F.lit(k) if edits is None else edits
    last = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda f: F.get(F.array(*[f[f"f{e}"] for e in range(k + 1)]), edits))
    reached = F.when(n == 0, m <= edits).otherwise(F.call_function("shiftright", last, m - n + k).bitwiseAND(F.lit(1)) == 1)
    return (F.abs(m - n) <= edits) & reached


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def near_texts(a: Column, b: Column, k: int = EDITS) -> Column:
    """Whether two texts are near, by k edits at most: common ends are cut off, then what is left is compared."""
    edits = bound(F.least(F.char_length(a), F.char_length(b)), k)

    def rest(s, then):
        return let(common_prefix(s.a, s.b), lambda p: let(F.struct(F.substr(s.a, p + 1).alias("a"), F.substr(s.b, p + 1).alias("b")), then))

    def chars(x):
        return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))

    def core(s):
        return let(F.struct(chars(s.a).alias("a"), chars(s.b).alias("b")), lambda t: within(t.a, t.b, k, edits))

    def turned(s):
        return let(F.struct(F.reverse(s.a).alias("a"), F.reverse(s.b).alias("b")), lambda t: rest(t, core))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: rest(s, turned))


def _letter_counts(line: Column) -> Column:
    """Counts of the letters, modulo 16, four bits each in one integer."""
    x = F.lit(0).cast("long")
    for i, c in enumerate(_LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        x = x.bitwiseOR(F.shiftleft(F.pmod(n, F.lit(16)).cast("long"), 4 * i))
    return x


def _all_counts(line: Column) -> list[Column]:
    """Counts of every character in 30 classes, modulo 16, four bits each in two integers: a to z, digits, capitals, spaces, others."""
    gone = [F.replace(line, F.lit(c), F.lit("")) for c in "abcdefghijklmnopqrstuvwxyz "] + [F.translate(line, x, "") for x in ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
    counts = [F.octet_length(line) - F.octet_length(g) for g in gone]
    counts.append(F.char_length(line) - sum(counts[1:], counts[0]))
    half = len(counts) // 2
    out = []
    for part in (counts[:half], counts[half:]):
        x = F.lit(0).cast("long")
        for i, n in enumerate(part):
            x = x.bitwiseOR(F.shiftleft(F.pmod(n, F.lit(16)).cast("long"), 4 * i))
        out.append(x)
    return out


def _counts_within(x: Column, y: Column, k: int, classes: int = len(_LETTERS)) -> Column:
    """An edit changes the counts by two at most, all together."""
    total = F.lit(0)
    for i in range(classes):
        d = F.pmod(F.shiftright(x, 4 * i).bitwiseAND(F.lit(15)) - F.shiftright(y, 4 * i).bitwiseAND(F.lit(15)), F.lit(16))
        total = total + F.least(d, 16 - d)
    return total <= 2 * k


def _no(tag: Column) -> Column:
    return F.shiftright(tag, 25).cast("int")


def meetings(lines: DataFrame, k: int = EDITS) -> DataFrame:
    """Lines (_k, no, line) that meet others in the index: key, k2, tag2, the key's first line k1, tag1, and several.

    A tag holds the line number, whether the key is one of the line's own segments, and its letter counts. Where one line
    alone has the segment, rows that can't be near it are left out. Where several have it, every line that probes it stays,
    with the first of them, so that the rows grow with the lines and not with the pairs.
    """
    counts = F.shiftleft(F.col("no").cast("long"), 25).bitwiseOR(_letter_counts(F.col("line")))
    rows = materialize(lines.select("_k", counts.alias("tag"), "line", F.char_length("line").alias("len")))
    index = keyed_segments(rows, index_specs, k).groupBy("key").agg(F.min("_k").alias("k1"), F.min_by("tag", "_k").alias("tag1"), (F.count("*") > 1).alias("several"))
    own = 1 << 24
    probe = keyed_segments(rows, probe_specs, k, own).select("key", F.col("_k").alias("k2"), F.col("tag").alias("tag2"))
    other = (F.col("k1") != F.col("k2")) | (_no(F.col("tag1")) != _no(F.col("tag2")))
    met = probe.join(index, "key").where(F.col("several") | (other & _counts_within(F.col("tag1"), F.col("tag2"), k)))
    out = materialize(met)
    release(rows)
    return out


def _pairs(met: DataFrame, k: int) -> DataFrame:
    """Distinct (k1, n1) before (k2, n2) of met (k1, tag1, k2, tag2) whose letter counts agree."""
    met = met.select("k1", _no(F.col("tag1")).alias("n1"), "k2", _no(F.col("tag2")).alias("n2"), F.col("tag1").alias("c1"), F.col("tag2").alias("c2")).where(((F.col("k1") != F.col("k2")) | (F.col("n1") != F.col("n2"))) & _counts_within(F.col("c1"), F.col("c2"), k))
    one, two = F.struct(F.col("k1").alias("k"), F.col("n1").alias("n")), F.struct(F.col("k2").alias("k"), F.col("n2").alias("n"))
    return met.select(F.least(one, two).alias("one"), F.greatest(one, two).alias("two")).select(F.col("one.k").alias("k1"), F.col("one.n").alias("n1"), F.col("two.k").alias("k2"), F.col("two.n").alias("n2")).distinct()


def _later(pairs: DataFrame, text: DataFrame, k: int) -> DataFrame:
    """The later line (_k, no) of each pair whose texts are near."""
    one = text.select(F.col("_k").alias("k1"), F.col("no").alias("n1"), F.col("line").alias("a"))
    two = text.select(F.col("_k").alias("k2"), F.col("no").alias("n2"), F.col("line").alias("b"))
    met = pairs.join(one, ["k1", "n1"]).join(two, ["k2", "n2"])
    return met.where(near_texts(F.col("a"), F.col("b"), k)).select(F.col("k2").alias("_k"), F.col("n2").alias("no")).distinct()


def near_lines(lines: DataFrame, pick, k: int = EDITS) -> DataFrame:
    """_k, no of the lines near to an earlier one; pick(wanted) gives the texts of wanted (_k, no).

    First every line is held against the first line of each segment it meets. Lines that go by that need no further pair:
    in a large group of near copies few are left. Those are held against all earlier lines that share a segment.
    """
    met = meetings(lines, k)
    both = met.select(F.col("k1").alias("_k"), _no(F.col("tag1")).alias("no")).unionByName(met.select(F.col("k2").alias("_k"), _no(F.col("tag2")).alias("no"))).distinct()
    c1, c2 = _all_counts(F.col("line"))
    text = materialize(pick(both).withColumn("c1", c1).withColumn("c2", c2))
    pairs = materialize(_pairs(met, k))
    gone = materialize(_later(pairs, text, k))
    members = met.where("several").select("key", F.col("k2").alias("_k"), F.col("tag2").alias("tag"), _no(F.col("tag2")).alias("no"))
    members = members.join(text.select("_k", "no", "c1", "c2"), ["_k", "no"]).join(gone.withColumn("gone", F.lit(True)), ["_k", "no"], "left").withColumn("gone", F.col("gone").isNotNull())
    members = materialize(members)
    x, y = members.alias("x"), members.where(F.shiftright("tag", 24).bitwiseAND(F.lit(1)) == 1).alias("y")
    order = (F.col("x._k") > F.col("y._k")) | ((F.col("x._k") == F.col("y._k")) & (F.col("x.no") > F.col("y.no")))
    open_ = F.when(order, ~F.col("x.gone")).otherwise(~F.col("y.gone"))
    other = (F.col("x._k") != F.col("y._k")) | (F.col("x.no") != F.col("y.no"))
    alike = _counts_within(F.col("x.c1"), F.col("y.c1"), k, 15) & _counts_within(F.col("x.c2"), F.col("y.c2"), k, 15)
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & other & open_ & alike)
    more = _pairs(more.select(F.col("x._k").alias("k1"), F.col("x.tag").alias("tag1"), F.col("y._k").alias("k2"), F.col("y.tag").alias("tag2")), k)
    more = materialize(more)
    late = materialize(_later(more, text, k))
    release(met, text, pairs, members, more)
    return gone.unionByName(late)


def _without(parts: Column, gone: Column) -> Column:
    """parts without the positions in gone (ascending): the runs between them, in time linear in both."""
    after = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda j: F.slice(parts, F.coalesce(F.get(gone, j - 1), F.lit(-1)) + 2, F.coalesce(F.get(gone, j), F.size(parts)) - F.coalesce(F.get(gone, j - 1), F.lit(-1)) - 1))
    return F.when(F.size(gone) == 0, parts).otherwise(F.flatten(after))


def _counted(line: Column) -> Column:
    """Whether equal lines are removed: those with a visible character, and white space of BLANK characters or more."""
    return (F.char_length(line) >= BLANK) | line.rlike(r"(?U)\S")


def line_dedup(docs: DataFrame, k: int = EDITS, rest: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text without the removed lines, n_lines, n_removed, _k and, with rest, a struct _rest of those columns of docs."""
    base = keyed(docs, rest=rest)
    texts = base.select("_k", "text")
    lines = base.select("_k", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(_counted(F.col("line")))
    hashes = lines.select("_k", "no", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), (F.char_length("line") >= PER_EDIT).alias("long"))
    first = materialize(hashes.groupBy("h1", "h2", "long").agg(F.min(F.struct("_k", "no")).alias("m")).select("m._k", "m.no", "long"))

    def pick(wanted: DataFrame) -> DataFrame:
        """_k, no, line of wanted (_k, no)."""
        lists = wanted.groupBy("_k").agg(F.collect_list("no").alias("want"))
        at = let(F.split("text", "\n"), lambda parts: F.transform("want", lambda n: F.struct(n.alias("no"), F.get(parts, n).alias("line"))))
        return texts.join(lists.hint("shuffle_hash"), "_k").select("_k", F.inline(at))

    near = near_lines(pick(first.where("long")), pick, k)
    stay = first.join(near, ["_k", "no"], "left_anti").groupBy("_k").agg(F.collect_list("no").alias("stay"))

    def cut(parts):
        counted = F.filter(F.transform(parts, lambda x, i: F.when(_counted(x), i)), lambda i: i.isNotNull())
        return let(F.array_except(counted, F.coalesce("stay", F.array().cast("array<int>"))), lambda gone: F.struct(F.size(parts).alias("n_lines"), F.size(gone).alias("n_removed"), F.array_join(_without(parts, gone), "\n").alias("text")))

    out = base.join(stay.hint("shuffle_hash"), "_k", "left").withColumn("done", let(F.split("text", "\n"), cut))
    n = {c: F.when(F.col("text").isNull(), 0).otherwise(F.col(f"done.{c}")).alias(c) for c in ("n_lines", "n_removed")}
    return out.select("doc_id", F.col("done.text").alias("text"), n["n_lines"], n["n_removed"], "_k", *["_rest"] * bool(rest))
