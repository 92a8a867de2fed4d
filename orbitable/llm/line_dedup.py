"""Line dedup by a segment-partition edit join, DataFrame functions only.

Lines within EDITS insertions, deletions and substitutions of each other are linked; of each
component of linked lines the first occurrence stays. Copies of a line are one line beforehand.
Two edits are a tenth of a line of MIN_CHARS characters; if the shorter of two lines has fewer, they are linked
within one edit, and below NEAR_CHARS characters only copies are one line.

*Segments.* A line of n characters belongs to the length band of n and has EDITS + 1 disjoint segments of one
length that the band fixes: EDITS of them from its start on, the last one at its end. If a longer line is
within EDITS edits, some segment i is untouched and has at most i - 1 edits before it (the smallest i
whose edits so far are at most i - 1), so it stands there shifted by at most i - 1; the last one stands at
the end. The longer line probes those places for the bands of its own and of shorter lengths.

*Short lines.* Lines one edit apart share a text with one character cut out, or the longer one without a character is the
shorter one. Such a text has few lines, however many begin or end alike.

*Filters inside the join*: lengths, and the counts of ten letters, of which an edit changes two by one.

*Crowded keys.* Classes need no list of all pairs of a group of near copies. First every line meets the HUBS least lines of its keys only,
which are all lines of most keys; that gives pieces. The other lines of a key with more of them are compared where their pieces differ, and
the distance is part of that join, so what it gives are links, never candidates. The comparisons themselves still grow with the
square of the lines of a key that are in no common piece.

*Verification.* Common ends are cut off, the rest goes through a banded bit-parallel edit distance: one
number holds the vertical differences of a diagonal band of 2 * EDITS + 1 cells and is updated per character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitable.llm.components import components
from orbitable.session import broadcast_checked, cut_lineage

EDITS = 2
MIN_CHARS = 20
NEAR_CHARS = 8
ANY_LENGTH = 1
BAND = 8
LETTERS = "etanirsohl"
HOT_COPIES, HOT_LINES = 64, 100_000
HUBS = 16
SPLIT_ROWS, MOST_SPLITS = 64, 16


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _common(a: Column, b: Column) -> Column:
    """Length of the common start of two texts (at most 2**17 - 1)."""
    most = F.least(F.char_length(a), F.char_length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(16, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(
        (n + k <= most) & (F.substring(a, F.lit(1), n + k) == F.substring(b, F.lit(1), n + k)), n + k).otherwise(n))


def edit_distance(a: Column, b: Column, limit: int = EDITS) -> Column:
    """Edit distance of two texts whose lengths differ by at most `limit`; any larger value means more than `limit`."""
    top = 2 * limit + 1
    ones = (1 << (top + 1)) - 1

    def no(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(ones).cast("long"))

    def bit(on: Column, at: int) -> Column:
        return F.when(on, F.lit(1 << at).cast("long")).otherwise(F.lit(0).cast("long"))

    def banded(p: Column) -> Column:
        """p.x: characters of the longer text, p.y: of the shorter one, which is not empty."""
        start = F.struct(F.lit(ones - (1 << (top - limit)) + 1).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"),
                         F.lit(limit).alias("d"), F.lit(1 << (top - 1)).cast("long").alias("h"))

        def step(s: Column, i: Column) -> Column:
            match = sum((bit(F.get(p["x"], i + limit - t) == F.get(p["y"], i), top - t) for t in range(1, 2 * limit + 1)),
                        bit(F.get(p["x"], i + limit) == F.get(p["y"], i), top))
            vp, vn = s["vp"], s["vn"]
            zero = _let(match, lambda x: (x.bitwiseAND(vp) + vp).bitwiseAND(F.lit(ones).cast("long")).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn))

            def after(d0: Column) -> Column:
                hp, hn, down = vn.bitwiseOR(no(d0.bitwiseOR(vp))), d0.bitwiseAND(vp), F.shiftright(d0, 1)
                diagonal = i < F.size(p["x"]) - limit
                change = F.when(diagonal, F.when(d0.bitwiseAND(F.lit(1 << top).cast("long")) == 0, 1).otherwise(0)).otherwise(
                    F.when(hp.bitwiseAND(s["h"]) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(s["h"]) != 0, 1).otherwise(0))
                return F.struct(hn.bitwiseOR(no(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
                                (s["d"] + change).alias("d"),
                                F.when(diagonal, s["h"]).otherwise(F.shiftright(s["h"], 1)).alias("h"))

            return _let(zero, after)

        return F.aggregate(F.sequence(F.lit(0), F.size(p["y"]) - 1), start, step, lambda s: s["d"])

    def trimmed(p: Column) -> Column:
        return F.when(F.char_length(p["y"]) == 0, F.char_length(p["x"])).when(
            F.char_length(p["x"]) <= limit, F.levenshtein(p["x"], p["y"])).otherwise(
            _let(F.struct(F.split(p["x"], "").alias("x"), F.split(p["y"], "").alias("y")), banded))

    def cut_start(p: Column) -> Column:
        return _let(_common(p["x"], p["y"]), lambda n: F.struct(
            F.reverse(F.substring(p["x"], n + 1, F.char_length(p["x"]))).alias("x"),
            F.reverse(F.substring(p["y"], n + 1, F.char_length(p["y"]))).alias("y")))

    longer = F.char_length(a) >= F.char_length(b)
    ordered = F.struct(F.when(longer, a).otherwise(b).alias("x"), F.when(longer, b).otherwise(a).alias("y"))
    return _let(ordered, lambda p: _let(cut_start(p), lambda q: _let(cut_start(q), trimmed)))


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line: document, text digest, position, line, its 128-bit digest and length."""
    rows = docs.filter("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc_id", "th", "pos", "line", F.xxhash64("line").alias("h1"),
                       F.xxhash64(F.lit("line"), "line").alias("h2"), F.char_length("line").alias("len"))


def _keys(edits: int, indexed: bool) -> Column:
    """Hashes of the segments of a line, or of the places where a shorter line's segments may stand in it."""
    line, n, found = F.col("line"), F.col("len"), []
    bands = [F.col("len")] if indexed else [n - k for k in range(edits + 1)]
    for k, length in enumerate(bands):
        band = F.floor(length / BAND).cast("int")
        size = F.floor(band * BAND / (edits + 1)).cast("int")
        places = [(i, i * size + shift) for i in range(edits) for shift in ([0] if indexed else range(-i, i + 1))]
        places.append((edits, n - size))
        # A shorter length in the band of the one before gives the same probes.
        fresh = F.lit(True) if k == 0 else band != F.floor(bands[k - 1] / BAND)
        for i, at in places:
            at = at if isinstance(at, Column) else F.lit(at)
            found.append(F.when(fresh & (size > 0) & (at >= 0) & (n >= MIN_CHARS), F.xxhash64(F.lit(i), band, F.substring(line, at + 1, size))))
    # Unlike a filter with a lambda, this is compiled together with the keys; it drops repeats as well.
    return F.array_except(F.array(*found), F.array(F.lit(None).cast("long")))


def _cut_keys(indexed: bool) -> Column:
    """Hashes of a short line without each of its characters; an indexed line also has its own."""
    line, n = F.col("line"), F.col("len")

    def key(text: Column) -> Column:
        return F.xxhash64(F.lit("cut"), text)

    cut = F.transform(F.sequence(F.lit(1), n), lambda i: key(F.concat(F.substring(line, F.lit(1), i - 1), F.substring(line, i + 1, n))))
    # A line of MIN_CHARS characters may be the longer one of a pair.
    short = n < (MIN_CHARS if indexed else MIN_CHARS + 1)
    return F.when(short, F.array_distinct(F.concat(cut, F.array(key(line))) if indexed else cut)).otherwise(F.array().cast("array<bigint>"))


def _shape() -> Column:
    """The length modulo 256 and the counts of the letters modulo 16, packed into one number."""
    packed = F.pmod(F.col("len"), F.lit(256)).cast("long")
    for c in LETTERS:
        times = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(c), F.lit("")))
        packed = F.shiftleft(packed, 4).bitwiseOR(F.pmod(times, F.lit(16)).cast("long"))
    return packed


def _shapes_fit(long: str, short: str, edits: int) -> Column:
    """Lengths and letter counts that `edits` edits can explain; both differences are least ones of their residues.

    Lines that meet on a key differ by less than two bands in length, so the residue decides.
    """
    def part(x: str, k: int) -> Column:
        return F.shiftright(F.col(x), 4 * k).bitwiseAND(F.lit(15).cast("long"))

    def gap(k: int) -> Column:
        apart = F.abs(part(long, k) - part(short, k))
        return F.least(apart, 16 - apart)

    longer = F.pmod(F.shiftrightunsigned(F.col(long), 4 * len(LETTERS)) - F.shiftrightunsigned(F.col(short), 4 * len(LETTERS)), F.lit(256))
    return (longer <= edits) & (sum((gap(k) for k in range(1, len(LETTERS))), gap(0)) <= 2 * edits)


def stored_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, pos, h1, h2) of the lines of at least `min_chars` characters, written once."""
    return cut_lineage(_lines(docs).filter(F.col("len") >= min_chars).select("doc_id", "th", "pos", "h1", "h2"))


def distinct_lines(rows: DataFrame) -> DataFrame:
    """(h1, h2, first, n): every distinct line, its first place and its number of occurrences."""
    return cut_lineage(rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count("*").alias("n")))


def _keyed(long_lines: DataFrame, lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(h1, h2, shape, k_s, k_l): keys and filters of every line, made once and written.

    Of a line with many copies only the first place is keyed. A line counts as such from HOT_LINES-th of all
    occurrences on, so there are at most HOT_LINES of them and they can be broadcast; copies of other
    lines meet and merge in the task of their key.
    """
    total = lines.agg(F.sum("n")).first()[0] or 0
    hot = lines.filter(F.col("n") >= max(HOT_COPIES, total / HOT_LINES)).select("h1", "h2", "first")
    once = long_lines.join(F.broadcast(hot), ["h1", "h2"], "left").filter(
        F.col("first").isNull() | (F.col("first") == F.struct("doc_id", "th", "pos")))
    keys = {tag: _keys(edits, indexed) if min_chars >= MIN_CHARS else F.concat(_keys(edits, indexed), _cut_keys(indexed))
            for tag, indexed in (("s", True), ("l", False))}
    return cut_lineage(once.select("h1", "h2", _shape().alias("shape"), *[k.alias(f"k_{tag}") for tag, k in keys.items()]))


def _side(keyed: DataFrame, tag: str) -> DataFrame:
    rows = keyed.select(F.explode(f"k_{tag}").alias("key"), F.col("h1").alias(f"h1_{tag}"), F.col("shape").alias(f"shape_{tag}"))
    return rows.repartition("key").distinct()


def _fit(edits: int) -> Column:
    # Of two lines of one length either may probe the other; one does.
    return _shapes_fit("shape_l", "shape_s", edits) & (F.col("h1_l") != F.col("h1_s")) & (
        (F.col("h1_l") > F.col("h1_s")) | (F.shiftrightunsigned("shape_l", 4 * len(LETTERS)) != F.shiftrightunsigned("shape_s", 4 * len(LETTERS))))


def _close(edits: int) -> Column:
    """Whether `line_l` and `line_s` are within the edits allowed for the shorter one."""
    allowed = F.when(F.char_length("line_s") < MIN_CHARS, min(1, edits)).otherwise(edits)
    near = F.abs(F.char_length("line_l") - F.char_length("line_s")) <= edits
    return near & (edit_distance(F.col("line_l"), F.col("line_s"), edits) <= allowed)


def _name() -> Column:
    return F.concat(F.hex("h1"), F.lit("-"), F.hex("h2"))


def _verified(pairs: DataFrame, long_lines: DataFrame, edits: int) -> DataFrame:
    """Links (a, b) among the candidate pairs (h1_s, h1_l)."""
    ids = cut_lineage(pairs.select(F.explode(F.array("h1_s", "h1_l")).alias("h1")).distinct())
    # Digests only name candidates here; should two lines share h1, both are verified.
    texts = long_lines.select("h1", "h2", "line").join(broadcast_checked(ids), "h1", "left_semi")
    texts = cut_lineage(texts.dropDuplicates(["h1", "h2"]).select("h1", "line", _name().alias("id")))
    for tag in ("s", "l"):
        named = texts.select(F.col("h1").alias(f"h1_{tag}"), F.col("line").alias(f"line_{tag}"), F.col("id").alias(f"id_{tag}"))
        pairs = pairs.join(named, f"h1_{tag}")
    return cut_lineage(pairs.filter(_close(edits)).select(F.col("id_s").alias("a"), F.col("id_l").alias("b")))


def _long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    return _lines(docs).filter(F.col("len") >= max(min_chars, NEAR_CHARS))


def line_links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, lines: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of digests of different lines within `edits` edits of each other, or one if the shorter has under MIN_CHARS characters.

    All pairs: their number grows with the square of a group of near copies. `line_classes` needs fewer.
    """
    lines = distinct_lines(stored_lines(docs, min_chars)) if lines is None else lines
    long_lines = _long_lines(docs, min_chars)
    keyed = _keyed(long_lines, lines, edits, min_chars)
    pairs = cut_lineage(_side(keyed, "s").join(_side(keyed, "l"), "key").filter(_fit(edits)).select("h1_s", "h1_l").distinct())
    return _verified(pairs, long_lines, edits)


def _across(keyed: DataFrame, crowded: DataFrame, pieces: DataFrame, long_lines: DataFrame, edits: int) -> DataFrame:
    """Links (a, b) between lines of different pieces that share a crowded key."""
    crowded = broadcast_checked(crowded)
    rows = [keyed.select(F.explode(f"k_{tag}").alias("key"), F.lit(tag).alias("tag"), "h1", "h2", "shape").join(crowded, "key", "left_semi")
            for tag in ("s", "l")]
    rows = cut_lineage(rows[0].unionByName(rows[1]).distinct())
    ids = cut_lineage(rows.select("h1", "h2").distinct())
    texts = long_lines.select("h1", "h2", "line").join(broadcast_checked(ids), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    named = texts.withColumn("id", _name()).join(pieces.withColumnRenamed("node", "id"), "id", "left")
    named = cut_lineage(named.select("h1", "h2", "line", "id", F.coalesce("component", "id").alias("piece")))
    rows = cut_lineage(rows.join(named, ["h1", "h2"]).drop("h2"))
    # Lines of a key's largest piece are not compared with each other; keys of one piece not at all.
    sizes = rows.groupBy("key", "piece").agg(F.count("*").alias("n"), F.count(F.when(F.col("tag") == "s", 1)).alias("n_s"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("n", "piece"))["piece"].alias("main"), F.count("*").alias("pieces"), F.sum("n_s").alias("n_s"))
    keys = keys.filter("pieces > 1").withColumn("blocks", F.least(F.ceil(F.col("n_s") / SPLIT_ROWS), F.lit(MOST_SPLITS)).cast("int"))
    rows = rows.join(cut_lineage(keys), "key").withColumn("rest", F.col("piece") != F.col("main"))

    def side(tag: str, block: Column) -> DataFrame:
        return rows.filter(F.col("tag") == tag).select(
            block.alias(f"block_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in ("key", "h1", "shape", "line", "id", "piece", "rest")])

    short = side("s", F.pmod(F.xxhash64("h1"), F.greatest("blocks", F.lit(1))).cast("int"))
    long = side("l", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    apart = (F.col("rest_s") | F.col("rest_l")) & (F.col("piece_s") != F.col("piece_l"))
    met = (F.col("key_s") == F.col("key_l")) & (F.col("block_s") == F.col("block_l")) & apart & _fit(edits) & _close(edits)
    found = [s.join(ll, met).select(F.col("id_s").alias("a"), F.col("id_l").alias("b"))
             for s, ll in ((short.filter("rest_s"), long), (short.filter("not rest_s"), long.filter("rest_l")))]
    return cut_lineage(found[0].unionByName(found[1]).distinct())


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, lines: DataFrame | None = None) -> DataFrame:
    """(node, component) of the digests of all lines that have a link: the components of `line_links`, without listing all links."""
    lines = distinct_lines(stored_lines(docs, min_chars)) if lines is None else lines
    long_lines = _long_lines(docs, min_chars)
    keyed = _keyed(long_lines, lines, edits, min_chars)
    # The least digests are the hubs, so that any other line of their length is the one that probes.
    ranked = _side(keyed, "s").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("h1_s")))
    # Where a key has more lines than hubs, the last hub or the line after it meets itself and marks the key: a line has each key of its
    # own on both sides, but for the one of a short line's whole text.
    marks = F.col("h1_l") == F.col("h1_s")
    met = ranked.filter(F.col("rank") <= HUBS + 1).join(_side(keyed, "l"), "key").filter(
        ((F.col("rank") <= HUBS) & _fit(edits)) | ((F.col("rank") >= HUBS) & marks))
    met = cut_lineage(met.select(F.when(marks, F.col("key")).alias("crowded"), F.when(~marks, F.col("h1_s")).alias("h1_s"),
                                 F.when(~marks, F.col("h1_l")).alias("h1_l")).distinct())
    links = _verified(met.filter("crowded is null").select("h1_s", "h1_l"), long_lines, edits)
    crowded = met.filter("crowded is not null").select(F.col("crowded").alias("key"))
    pieces = components(links)
    if crowded.isEmpty():
        return pieces
    pieces = cut_lineage(pieces)
    more = _across(keyed, crowded, pieces, long_lines, edits)
    return components(pieces.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, pos, near) of the line occurrences to remove; `th` is the text's hash.

    All but the first occurrence (by doc_id, text hash, position) of each class of lines. `near`: the
    first occurrence of the class has another wording. Lines under `min_chars` characters are left
    alone, and so are rows with a null doc_id or text.
    """
    rows = stored_lines(docs, min_chars)
    lines = distinct_lines(rows)
    comps = line_classes(docs, edits, min_chars, lines)
    classed = lines.withColumn("node", _name()).join(comps, "node", "left")
    alone = classed.filter("component is null and n > 1").select("h1", "h2", "first", F.col("first").alias("head"))
    linked = classed.filter("component is not null")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "component").select("h1", "h2", "first", "head")
    known = cut_lineage(alone.unionByName(linked).select("h1", "h2", "head", (F.col("first") != F.col("head")).alias("near")))
    met = rows.join(known, ["h1", "h2"]).filter(F.struct("doc_id", "th", "pos") != F.col("head"))
    return cut_lineage(met.select("doc_id", "th", "pos", "near").distinct())


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` without the repeated lines; all columns stay, `text` holds the remaining lines.

    Rows whose lines are all removed are left out, null texts and null ids stay as they are.
    """
    gone = repeated_lines(docs, edits, min_chars).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("th"),
                       F.split("text", "\n").alias("parts"))
    rows = rows.join(gone, ["doc_id", "th"], "left")
    # Positions are subtracted as sets, which stays linear in the lines of a document.
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone"), lambda i: F.get("parts", i))
    rows = rows.select("row", F.when(F.col("gone").isNotNull(), left).alias("left")).filter("left is null or size(left) > 0")
    text = F.when(F.col("left").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def line_report(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_near, removed) per row of `docs`; `removed` lists positions from 0."""
    gone = repeated_lines(docs, edits, min_chars).groupBy("doc_id", "th").agg(
        F.count("*").alias("n_removed"), F.sum(F.col("near").cast("long")).alias("n_near"), F.array_sort(F.collect_set("pos")).alias("removed"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
                       F.col("text").isNull().alias("empty"))
    rows = rows.withColumn("n_lines", F.when(F.col("empty"), 0).otherwise(F.col("n_lines")))
    out = rows.join(gone, ["doc_id", "th"], "left")
    return out.select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                      F.coalesce("n_near", F.lit(0)).alias("n_near"),
                      F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
