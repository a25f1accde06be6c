"""Line dedup by a segment-partition edit join (operator 8), in DataFrame functions only.

Lines within some edits of each other, more for longer lines, are one group; the first line of a group stays, the others go. If a line is cut
into one segment more than edits, every line within that many edits holds one of the segments unchanged, and its place can
have moved only a little. So each distinct line is indexed by its segments under its length, and looked up by those of its
substrings that can be a segment of an equally long or slightly shorter line. Pairs that meet are verified by a
bit-parallel edit distance over a narrow band of the matrix: one number holds the band, whatever the length of the line.

Keys under which many lines are indexed are not joined. First their lines are compared with two of them, the most frequent line
and one more: only groups matter, so lines that are linked over these need no other link between them, and a family of any size
costs a comparison or two a line. Lines that are still apart are cut again without the shared segment: the rests are
within so many edits as well, so that the same index applies to them, below the shared segment's key. This goes on until no key
is crowded or the rests have become so short that nothing is left to cut; lines of one group never meet there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlog.llm.common import documents, row_key, written
from searchlog.llm.components import connected_components

#: Edits of the shortest lines.
MAX_EDITS = 1

#: Edits by the characters of the shorter line, from so many on: about one in 25, three at most.
EDITS = ((0, MAX_EDITS), (50, 2), (75, 3))

#: Shorter lines, in characters, are left alone: "}" or "Yes." repeat by right.
MIN_CHARS = 20

#: Lines indexed under one key before they are compared with two of them, and cut again.
CROWDED = 100

#: Characters whose counts are compared before two lines are.
COMMON = "etaoinsrhldcum ,."

#: Cuts below the first; a rest is then a tenth or less of its line for one edit.
MAX_CUTS = 12


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _segments(k: int) -> list[tuple[int, int, int]]:
    """The segments under which a text is indexed, as (0, segment, 0)."""
    return [(0, i, 0) for i in range(k + 1)]


def _lookups(k: int) -> list[tuple[int, int, int]]:
    """Substrings that can be a segment of a text shorter by 0 to k: by how much, which segment, how far it has moved.

    With i segments before it and k - i after it, a segment that stays whole moves no further than this.
    """
    return [
        (d, i, move)
        for d in range(k + 1)
        for i in range(k + 1)
        for move in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1)
    ]


def _edits_of(length: Column, edits: tuple[tuple[int, int], ...]) -> Column:
    """The edits that a line of that length allows."""
    return F.coalesce(*[F.when(length >= least, k) for least, k in reversed(edits)])


def _classed(rows: DataFrame, edits: tuple[tuple[int, int], ...]) -> DataFrame:
    """``rows`` with their edits ``k``; lines that are as long as the next class, but can be near a shorter one, come twice."""
    length = F.char_length("line")
    classes = []
    for n, (least, k) in enumerate(edits):
        below = [length < start + k for start, _ in edits[n + 1 : n + 2]]
        classes.append(F.when(reduce(lambda a, b: a & b, below, length >= least), k))
    return rows.withColumn("k", F.explode(F.array_compact(F.array(*classes))))


def _by_edits(edits: tuple[tuple[int, int], ...], make: Callable[[int], Column]) -> Column:
    """What ``make`` gives for a row's ``k``. So one plan serves all classes of lengths."""
    return F.coalesce(*[F.when(F.col("k") == k, make(k)) for k in sorted({k for _, k in edits})])


def _keyed(
    rows: DataFrame,
    keep: list[str],
    text: Column,
    salt: Column,
    edits: tuple[tuple[int, int], ...],
    places: Callable[[int], list[tuple[int, int, int]]],
) -> DataFrame:
    """``keep``, ``k``, ``key`` and the shorter text's difference ``d`` of every part of ``text`` that ``places`` names for ``k``.

    The places are rows and their key is one expression. Spelt out for each of the 42 places of three classes, keys make code that
    Spark cannot compile, or that Java only interprets.
    """

    def listed(k: int) -> Column:
        return F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(place, ("d", "part", "move"), strict=True)]) for place in places(k)])

    def begin(part: Column) -> Column:
        return F.call_function("div", F.col("length") * part, F.col("k") + 1).cast("int")

    rows = rows.select(*keep, "k", text.alias("text"), salt.alias("salt"), F.char_length(text).alias("n"))
    rows = rows.select("*", F.inline(_by_edits(edits, listed))).withColumn("length", F.col("n") - F.col("d"))
    size, start = begin(F.col("part") + 1) - begin(F.col("part")), begin(F.col("part")) + F.col("move")
    rows = rows.withColumns({"size": size, "start": start})
    rows = rows.filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    part = F.col("text").substr(F.col("start") + 1, F.col("size"))
    return rows.withColumn("key", F.xxhash64("salt", "length", "part", part))


def _rest() -> Column:
    """The text of a row of ``_keyed`` without the part."""
    after = F.col("text").substr(F.col("start") + F.col("size") + 1, F.col("n"))
    return F.concat(F.col("text").substr(F.lit(1), F.col("start")), after).alias("rest")


def _index_rows(rows: DataFrame, text: Column, salt: Column, edits: tuple[tuple[int, int], ...]) -> DataFrame:
    keyed = _keyed(rows, ["line_id", "family"], text, salt, edits, _segments)
    return keyed.select("line_id", "family", "k", "key", _rest())


def _probe_rows(rows: DataFrame, text: Column, salt: Column, edits: tuple[tuple[int, int], ...]) -> DataFrame:
    """Lookups of every length difference, or of the one that a row has."""
    known = [c for c in rows.columns if c == "delta"]
    keyed = _keyed(rows, ["line_id", "family", *known], text, salt, edits, _lookups)
    for delta in known:
        keyed = keyed.filter(F.col("d") == F.col(delta))
    return keyed.select("line_id", "family", "k", "key", _rest(), F.col("d").alias("delta"))


def within_edits(short: Column, long: Column, k: int) -> Column:
    """Whether two arrays of characters are within k edits; ``long`` has 0 to k characters more, ``short`` over k in all.

    A band of 2k + 2 bits moves down the matrix with the columns: its top bit is k rows below the diagonal. At the bottom of the
    matrix the last row's bit moves down through the band. Neighbouring rows differ by one at most, so that the whole band is
    over k once its lowest row is far over it; from there on nothing is computed.
    """
    width = 2 * k + 2
    top, full = 1 << (width - 1), (1 << width) - 1
    rows, columns = F.size(short), F.size(long)

    def step(state: Column, i: Column) -> Column:
        letter = F.get(long, i)
        equal = reduce(
            lambda a, b: a.bitwiseOR(b),
            [
                F.when(F.get(short, i + k - o) == letter, _long(top >> o)).otherwise(_long(0)) for o in range(width)
            ],
        )
        mask = _long(full)
        up, down = state["up"], state["down"]
        carried = (equal.bitwiseAND(up) + up).bitwiseAND(mask)
        same = carried.bitwiseXOR(up).bitwiseOR(equal).bitwiseOR(down)
        plus = down.bitwiseOR(mask.bitwiseXOR(same.bitwiseOR(up)))
        minus = same.bitwiseAND(up)
        half = F.shiftrightunsigned(same, 1)
        past = i - (rows - k)  # steps since the band reached the last row
        row = F.when(past >= 0, F.pow(F.lit(2.0), F.lit(width - 2) - past)).otherwise(0.0).cast("long")
        on_way = F.when(same.bitwiseAND(_long(top)) == 0, 1).otherwise(0)
        at_end = F.when(plus.bitwiseAND(row) != 0, 1).when(minus.bitwiseAND(row) != 0, -1).otherwise(0)
        after = F.struct(
            minus.bitwiseOR(mask.bitwiseXOR(half.bitwiseOR(plus))).alias("up"),
            half.bitwiseAND(plus).alias("down"),
            (state["edits"] + F.when(past < 0, on_way).otherwise(at_end)).alias("edits"),
        )
        return F.when(state["edits"] > k + width, state).otherwise(after)

    start = F.struct(
        _long(((1 << (k + 1)) - 1) << (width - k - 1)).alias("up"), _long(0).alias("down"), F.lit(k).alias("edits")
    )
    return F.aggregate(F.sequence(F.lit(0), columns - 1), start, step)["edits"] <= k


def _candidates(index: DataFrame, probe: DataFrame, crowded: DataFrame | None, families: bool) -> DataFrame:
    if crowded is not None:
        index, probe = (side.join(crowded, "key", "left_anti") for side in (index, probe))
    extra = [["family"], ["delta", "family"]] if families else [[], ["delta"]]
    left = index.select("key", F.col("line_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in extra[0]])
    right = probe.select("key", F.col("line_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in extra[1]])
    # Lines of one length meet both ways round.
    apart = (F.col("a") != F.col("b")) & ((F.col("b_delta") > 0) | (F.col("a") < F.col("b")))
    if families:
        apart &= F.col("a_family") != F.col("b_family")
    return left.join(right, "key").filter(apart).select("a", "b")


def _count(text: Column, letter: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, letter, ""))


def _parities(text: Column) -> Column:
    """64 bits, each of which tells whether the pairs of neighbouring characters that hash to it are odd in number.

    An edit takes away two such pairs and brings two at most, so that it changes at most four bits, whatever the length.
    """

    def fold(letters: Column) -> Column:
        def bit(i: Column) -> Column:
            place = F.xxhash64(F.get(letters, i), F.get(letters, i + 1)).bitwiseAND(63).cast("int")
            return F.call_function("shiftleft", _long(1), place)

        places = F.sequence(F.lit(0), F.size(letters) - 2)
        return F.when(F.size(letters) > 1, F.aggregate(places, _long(0), lambda bits, i: bits.bitwiseXOR(bit(i)))).otherwise(_long(0))

    return F.transform(F.array(F.split(text, "")), fold)[0]


def _sides(pairs: DataFrame, texts: DataFrame, column: str, names: tuple[str, str]) -> DataFrame:
    """``pairs`` with a column of the lines of both ends."""
    for end, name in zip("ab", names, strict=True):
        pairs = pairs.join(texts.select(F.col("line_id").alias(end), F.col(column).alias(name)), end)
    return pairs


def _texts(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines of some ids; the ids are few next to the lines, and Spark broadcasts them if they are small."""
    return lines.join(ids, "line_id", "left_semi").select("line_id", "line")


def near_lines(lines: DataFrame, edits: tuple[tuple[int, int], ...] = EDITS, crowded: int = CROWDED) -> DataFrame:
    """Pairs ``a``, ``b`` of ``line_id`` whose ``line`` is within the edits of the shorter one; ``lines`` may repeat lines.

    The pairs are enough to make the groups of lines that are linked directly or over others. They are not all pairs: of a crowded
    key, lines that are linked over others may have no pair of their own. The lines of a length class share keys only with each other
    and with the lines that are longer by its edits at most. A pair may come twice.
    """
    once = lines.groupBy("line_id", "line").agg(F.count("*").alias("times"))
    # A number takes half the room of an id, and less when it is compressed, in the many rows of keys that are shuffled.
    once = written(once.withColumn("number", F.monotonically_increasing_id()), "distinct-lines")
    numbered = once.select(F.col("number").alias("line_id"), "line", "times")
    pairs = _near_lines(numbered, edits, crowded).select(F.col("a").alias("x"), F.col("b").alias("y"))
    for number, end in zip("xy", "ab", strict=True):
        pairs = pairs.join(once.select(F.col("number").alias(number), F.col("line_id").alias(end)), number)
    return pairs.select("a", "b")


def _verified(pairs: DataFrame, lines: DataFrame, edits: tuple[tuple[int, int], ...]) -> DataFrame:
    """The pairs within the edits of the shorter line. Only the lines of candidates are read again."""
    pairs = written(pairs.distinct(), "line-candidates")
    ids = pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).distinct()
    mark = F.struct(_parities(F.col("line")).alias("bits"), _edits_of(F.char_length("line"), edits).alias("k"))
    texts = written(_texts(lines, ids).withColumn("mark", mark), "candidate-lines")
    # Some bytes a line leave few pairs whose texts have to meet.
    alike = _sides(pairs, texts, "mark", ("x", "y")).withColumn("k", F.least("x.k", "y.k"))
    alike = alike.filter(F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= 4 * F.col("k"))
    met = _sides(alike.select("a", "b", "k"), texts, "line", ("x", "y"))
    # An edit changes the count of a letter by one at most, too, as it does the length.
    counts = [F.abs(F.char_length("x") - F.char_length("y")) <= F.col("k")]
    counts += [F.abs(_count(F.col("x"), c) - _count(F.col("y"), c)) <= F.col("k") for c in COMMON]
    met = met.filter(reduce(lambda a, b: a & b, counts))
    # Bound to a variable, the two arrays are made once for each pair; as columns they would be made again at each step.
    ordered = F.char_length("x") <= F.char_length("y")
    short, long = F.when(ordered, F.col("x")).otherwise(F.col("y")), F.when(ordered, F.col("y")).otherwise(F.col("x"))
    letters = F.array(F.struct(F.split(short, "").alias("x"), F.split(long, "").alias("y")))
    near = F.transform(letters, lambda pair: _by_edits(edits, lambda k: within_edits(pair["x"], pair["y"], k)))[0]
    return met.filter(near).select("a", "b")


def _families(index: DataFrame, probe: DataFrame, lines: DataFrame, edits: tuple[tuple[int, int], ...]) -> DataFrame:
    """Links of the lines under crowded keys to the most frequent line under the key and to the smallest one."""
    heads = index.groupBy("key").agg(
        F.max_by("line_id", F.struct("times", "line_id")).alias("often"), F.min("line_id").alias("least")
    )
    members = index.select("key", "line_id").union(probe.select("key", "line_id")).distinct()
    pairs = members.join(heads, "key").select("line_id", F.explode(F.array("often", "least")).alias("head"))
    pairs = pairs.filter(F.col("line_id") != F.col("head"))
    return _verified(pairs.select(F.least("line_id", "head").alias("a"), F.greatest("line_id", "head").alias("b")), lines, edits)


def _apart(index: DataFrame, probe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides without the keys under which all lines are of one family."""
    sides = index.select("key", "family").union(probe.select("key", "family"))
    mixed = sides.groupBy("key").agg(F.min("family").alias("low"), F.max("family").alias("high"))
    mixed = mixed.filter(F.col("low") != F.col("high")).select("key")
    return index.join(mixed, "key", "left_semi"), probe.join(mixed, "key", "left_semi")


def _near_lines(lines: DataFrame, edits: tuple[tuple[int, int], ...], crowded: int) -> DataFrame:
    """Pairs of different lines, each there once, within their edits that make the groups.

    Keys are made from the lines whenever they are needed: those of a line take more room than the line.
    """
    line, root = F.col("line"), F.col("k").cast("long")
    classed = _classed(lines, edits)
    index = _keyed(classed, ["line_id", "times"], line, root, edits, _segments).select("line_id", "times", "key")
    probe = _keyed(classed, ["line_id"], line, root, edits, _lookups).select("line_id", "key", F.col("d").alias("delta"))

    found, linked = [], []
    for cut in range(MAX_CUTS + 1):
        sizes = index.groupBy("key").count().filter(F.col("count") > crowded)
        hot = written(sizes.select("key"), "crowded-keys") if cut < MAX_CUTS else None
        if hot is None or hot.isEmpty():
            found.append(_candidates(index, probe, None, cut > 0))
            break
        found.append(_candidates(index, probe, hot, cut > 0))
        if cut == 0:  # the rests were not made so far, as they are as long as the lines
            sides = [written(side.join(hot, "key", "left_semi"), "crowded-sides") for side in (index, probe)]
            linked.append(written(_families(*sides, lines, edits), "family-links"))
            ids = written(sides[0].select("line_id").union(sides[1].select("line_id")).distinct(), "crowded-ids")
            families = connected_components(linked[0], "a", "b").withColumnRenamed("node", "line_id")
            texts = _texts(lines, ids).join(families, "line_id", "left")
            texts = texts.select("line_id", "line", F.coalesce("component", "line_id").alias("family"))
            texts = _classed(written(texts, "crowded-lines"), edits)
            index, probe = _index_rows(texts, line, root, edits), _probe_rows(texts, line, root, edits)
        index, probe = _apart(index.join(hot, "key", "left_semi"), probe.join(hot, "key", "left_semi"))
        index, probe = written(index, "crowded-index"), written(probe, "crowded-probe")
        index = _index_rows(index, F.col("rest"), F.col("key"), edits)
        probe = _probe_rows(probe, F.col("rest"), F.col("key"), edits)
    return reduce(DataFrame.unionByName, [_verified(reduce(DataFrame.unionByName, found), lines, edits), *linked])


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def without_repeated_lines(
    df: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    max_edits: int | None = None,
    min_chars: int = MIN_CHARS,
    crowded: int = CROWDED,
) -> DataFrame:
    """Every row of ``df`` with its text less the repeated lines, and ``n_lines`` and ``n_removed``.

    Lines are compared without white space at their ends. Of all lines within ``max_edits`` edits of each other (by default those
    that ``EDITS`` gives for the shorter line), directly or over others, the one with the smallest id, row key and place stays.
    Lines of fewer than ``min_chars`` characters stay. Null texts stay null with zero lines, empty ones stay empty; a text may
    become empty. Repeated rows (equal id and text) are one document and keep the same lines. Input columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    edits = EDITS if max_edits is None else ((0, max_edits),)
    if not all(1 <= k < min(max(least, min_chars), 25) for least, k in edits):
        raise ValueError("max_edits must be from 1 to 24 and below min_chars")
    keyed = df.select(F.col(id_column).alias("id"), row_key(id_column, text).alias("row"), F.col(text).alias("text"))
    lines = keyed.select("id", "row", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(" \t\r\f\v"))).filter(F.char_length("line") >= min_chars)
    lines = lines.withColumn("line_id", F.unhex(F.md5("line")))

    linked = connected_components(near_lines(lines.select("line_id", "line"), edits, crowded), "a", "b")

    where = F.struct("id", "row", "place")
    places = lines.drop("line")
    groups = (
        places.groupBy("line_id")
        .agg(F.min(where).alias("first"), F.count("*").alias("n"))
        .join(linked.withColumnRenamed("node", "line_id"), "line_id", "left")
        .withColumn("component", F.coalesce("component", "line_id"))
    )
    kept = groups.groupBy("component").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).filter(F.col("n") > 1)
    repeated = groups.select("line_id", "component").join(kept, "component").select("line_id", "kept")
    removed = places.join(repeated, "line_id").filter(where != F.col("kept"))
    by_row = removed.groupBy("row").agg(F.collect_set("place").alias("_removed"))

    taken = {text, "n_lines", "n_removed"}
    rows = df.select(F.struct(*df.columns).alias("_in"), row_key(id_column, text).alias("row"))
    joined = rows.join(by_row, "row", "left")
    every = _lines(F.col(f"_in.`{text}`"))
    left = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("_removed")), lambda place: F.get(every, place)
    )
    return joined.select(
        *[F.col(f"_in.`{c}`").alias(c) for c in df.columns if c not in taken],
        F.when(F.col("_removed").isNull(), F.col(f"_in.`{text}`")).otherwise(F.array_join(left, "\n")).alias(text),
        F.when(F.col(f"_in.`{text}`").isNull(), 0).otherwise(F.size(every)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )
