"""Query-text expressions (T1-T6): all native, regular expressions plus higher-order functions.

A text is cut into *segments*: the marks ``| [ ]`` and the runs between them, where quoted strings and back-quoted macros
belong to the run whatever they contain. Each segment keeps the whitespace before it, so that joining segments gives the
text back. A run is made of *atoms*: quoted strings, macros, and what lies between. A stage starts at the text start,
after ``|`` and after ``[``. A text with unbalanced brackets or an open quote is not well formed and yields null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchlog.functions.normalize import truth_value
from searchlog.functions.taxonomy import MISCELLANEOUS, category_of, is_known_command

# Possessive repetition keeps the match iterative, so very long quoted strings cannot exhaust the stack.
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_MACRO = r"`[^`]*+`"
_RUN = rf'(?:{_QUOTED}|{_MACRO}|[^"`\[\]|]++)++'
SEGMENT = rf'(?s)\s*+(?:[\[\]|]|{_RUN}|["`])'
ATOM = rf'(?s)\s*+(?:{_QUOTED}|{_MACRO}|[\[\]|]|[^"`\[\]|]++|["`])'
_FLAT_STAGE = rf"(?s)\|\s*+(?:{_RUN})?+|{_RUN}"
_WORD = rf'(?s)^(?:{_QUOTED}|{_MACRO}|[^\s"`\[\]|]++)'
_OPTION = _QUOTED + r"|\w+\s*=\s*(?:" + _QUOTED + r'|[^\s,"\[\]|]+)'
_WHITESPACE = " \t\n\r\f\x0b"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(_WHITESPACE))


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _marks(segments: Column) -> Column:
    return F.transform(segments, _strip)


def _has_brackets(text: Column) -> Column:
    return text.contains("[") | text.contains("]")


def _is_well_formed(text: Column, marks: Column) -> Column:
    depth = F.aggregate(
        marks,
        F.lit(0),
        lambda d, v: F.when(d < 0, d).when(v == "[", d + 1).when(v == "]", d - 1).otherwise(d),
    )
    balanced = ~_has_brackets(text) | (depth == 0)
    return balanced & ~F.array_contains(marks, '"') & ~F.array_contains(marks, "`")


def well_formed(text: Column) -> Column:
    """Whether brackets and quotes balance."""
    return _let(_marks(_pieces(text, SEGMENT)), lambda marks: _is_well_formed(text, marks))


def _is_mark(segment: Column) -> Column:
    return segment.isin("|", "[", "]")


def _starts_stage(marks: Column, index: Column) -> Column:
    at_start = (index == 0) | F.get(marks, index - 1).isin("|", "[")
    return at_start & ~_is_mark(F.get(marks, index))


def _first_word(head: Column) -> Column:
    return F.regexp_extract(head, _WORD, 0)


def _word_class(word: Column) -> Column:
    return (
        F.when(word.startswith("`"), "MACRO")
        .when(is_known_command(F.lower(word)), "COMMAND")
        .otherwise("EXTERNAL_COMMAND")
    )


def _token(cls: Column | str, value: Column) -> Column:
    cls = F.lit(cls) if isinstance(cls, str) else cls
    return F.struct(cls.alias("token_class"), value.alias("value"))


def _tokens_of_run(run: Column, starts: Column) -> Column:
    """The word that opens a stage and the arguments, atom by atom."""

    def arguments(text: Column) -> Column:
        return F.transform(_pieces(text, ATOM), lambda a: _token("ARGS", _strip(a)))

    def head(word: Column) -> Column:
        rest = _strip(F.substr(run, F.length(word) + 1))
        return F.concat(F.array(_token(_word_class(word), word)), arguments(rest))

    return F.when(starts, _let(_first_word(run), head)).otherwise(arguments(run))


def tokens(text: Column) -> Column:
    """``array<struct<token_class, value>>`` in text order."""

    def classify(marks: Column) -> Column:
        return F.flatten(
            F.transform(
                marks,
                lambda v, i: F.when(v == "|", F.array(_token("PIPE", v)))
                .when(v == "[", F.array(_token("LBRACKET", v)))
                .when(v == "]", F.array(_token("RBRACKET", v)))
                .otherwise(_tokens_of_run(v, _starts_stage(marks, i))),
            )
        )

    return _let(
        _marks(_pieces(text, SEGMENT)), lambda marks: F.when(_is_well_formed(text, marks), classify(marks))
    )


def _spaced(text: Column) -> Column:
    """Atoms joined by one blank."""
    plain = ~text.contains('"') & ~text.contains("`") & ~text.contains("|")
    return F.when(plain, _strip(text)).otherwise(F.array_join(F.transform(_pieces(text, ATOM), _strip), " "))


def _is_bracket(mark: Column) -> Column:
    return mark.isin("[", "]")


def _with_depths(marks: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the brackets ``(i, v, before, after)`` and of all other segments ``(i, v, depth)``, in text order.

    No depth is carried along. The j-th opening bracket that is the p-th of all brackets has p - j closing ones before it, so it
    opens depth 2j + 1 - p; the k-th closing one ends depth p - 2k. Any other segment has the depth after the bracket before it, and
    how many brackets come before it follows from its place among all segments and among the others. Everything is a
    filter, a lookup or a sort of the segments.
    """

    def numbered(array: Column) -> Column:
        return F.transform(array, lambda x, n: F.struct(x["i"].alias("i"), x["v"].alias("v"), n.alias("n")))

    def depths(brackets: Column) -> Column:
        opening = F.transform(
            F.filter(brackets, lambda b: b["v"] == "["),
            lambda b, j: F.struct(b["i"].alias("i"), b["v"].alias("v"), (2 * j - b["n"]).alias("before"), (2 * j + 1 - b["n"]).alias("after")),
        )
        closing = F.transform(
            F.filter(brackets, lambda b: b["v"] == "]"),
            lambda b, k: F.struct(b["i"].alias("i"), b["v"].alias("v"), (b["n"] - 2 * k).alias("before"), (b["n"] - 2 * k - 1).alias("after")),
        )
        return F.sort_array(F.concat(opening, closing))

    def rest(others: Column, brackets: Column) -> Column:
        def known(x: Column) -> Column:
            depth = F.coalesce(F.get(brackets, x["i"] - x["n"] - 1)["after"], F.lit(0))
            return F.struct(x["i"].alias("i"), x["v"].alias("v"), depth.alias("depth"))

        return F.transform(others, known)

    indexed = F.transform(marks, lambda v, i: F.struct(i.alias("i"), v.alias("v")))

    def split(segments: Column) -> Column:
        return F.struct(
            depths(numbered(F.filter(segments, lambda x: _is_bracket(x["v"])))).alias("brackets"),
            numbered(F.filter(segments, lambda x: ~_is_bracket(x["v"]))).alias("others"),
        )

    def placed(parts: Column) -> Column:
        return F.struct(parts["brackets"].alias("brackets"), rest(parts["others"], parts["brackets"]).alias("others"))

    return _let(_let(_let(indexed, split), placed), lambda parts: body(parts["brackets"], parts["others"]))


def split_stages(text: Column) -> Column:
    """The top-level stages as strings, atoms joined by one blank.

    Pipes inside quotes or brackets do not split. A stage opened by a pipe keeps it as its first token. Closing the
    outermost bracket ends the stage. Works in a time that grows with the text, whatever the brackets in it.
    """

    def begins(brackets: Column, others: Column) -> Column:
        pipes = F.filter(others, lambda x: (x["v"] == "|") & (x["depth"] == 0))
        ends = F.filter(brackets, lambda b: (b["v"] == "]") & (b["after"] == 0))
        places = F.concat(F.array(F.lit(0)), F.transform(pipes, lambda x: x["i"]), F.transform(ends, lambda b: b["i"] + 1))
        return F.sort_array(F.array_distinct(places))

    def piece(marks: Column, begin: Column, end: Column) -> Column:
        spaced = F.transform(
            F.slice(marks, begin + 1, end - begin), lambda v: F.when(_is_mark(v), v).otherwise(_spaced(v))
        )
        return F.array_join(spaced, " ")

    def pieces(marks: Column, places: Column) -> Column:
        each = F.transform(
            places, lambda begin, n: F.struct(begin.alias("begin"), F.coalesce(F.get(places, n + 1), F.size(marks)).alias("end"))
        )
        full = F.filter(each, lambda p: p["begin"] < p["end"])
        return F.transform(full, lambda p: piece(marks, p["begin"], p["end"]))

    def split(marks: Column) -> Column:
        flat = F.filter(F.transform(_pieces(text, _FLAT_STAGE), _spaced), lambda s: s != "")
        nested = _let(_with_depths(marks, begins), lambda places: pieces(marks, places))
        return F.when(_has_brackets(text), nested).otherwise(flat)

    return _let(
        _marks(_pieces(text, SEGMENT)), lambda marks: F.when(_is_well_formed(text, marks), split(marks))
    )


def command_words(text: Column) -> Column:
    """``array<struct<token_class, value>>`` of the stage-opening words at every depth, in text order."""

    def heads(marks: Column) -> Column:
        first = F.filter(F.transform(marks, lambda v, i: F.when(_starts_stage(marks, i), v)), lambda v: v.isNotNull())
        return F.transform(first, lambda v: _let(_first_word(v), lambda w: _token(_word_class(w), F.lower(w))))

    return _let(_marks(_pieces(text, SEGMENT)), lambda marks: F.when(_is_well_formed(text, marks), heads(marks)))


def commands(text: Column) -> Column:
    """The commands in order, lower-cased, macros and external commands included."""
    return F.transform(command_words(text), lambda w: w["value"])


def addtotals_kind(args: Column) -> Column:
    """T5: ``addtotals col`` or ``addtotals row`` by the first option ``col`` or ``row`` that is true; else row."""
    options = F.regexp_extract_all(args, F.lit(_OPTION), F.lit(0))
    name = r"^(col|row)\s*="

    def is_true(option: Column) -> Column:
        return truth_value(F.regexp_replace(option, name + r'\s*"?([^"]*)"?$', "$2"))

    chosen = F.filter(options, lambda o: o.rlike(name) & is_true(o))
    return F.concat(
        F.lit("addtotals "), F.coalesce(F.regexp_extract(F.get(chosen, F.lit(0)), name, 1), F.lit("row"))
    )


def stage_category(command: Column, token_class: Column, args: Column) -> Column:
    """T4 for one stage: macro, taxonomy (``addtotals`` by its options), or Miscellaneous for external commands."""
    name = F.when(command == "addtotals", addtotals_kind(args)).otherwise(command)
    return F.when(token_class == "MACRO", F.lit("Macro")).otherwise(
        F.coalesce(category_of(name), F.lit(MISCELLANEOUS))
    )


def _flat_spans(marks: Column) -> Column:
    """Without brackets every run is a stage."""
    each = F.transform(
        marks, lambda v, i: F.when(v != "|", F.struct(i.alias("begin"), F.lit(0).alias("depth"), (i + 1).alias("end")))
    )
    return F.filter(each, lambda span: span.isNotNull())


def _nested_spans(marks: Column) -> Column:
    """Begin, depth and end of every stage, in text order.

    A stage ends at the next pipe of its depth or where its bracket closes. Between two beginnings at one depth there is always
    such an end, so among all beginnings and ends in the order of depth and place, a beginning's end is the one after it.
    """

    def spans(brackets: Column, others: Column) -> Column:
        def event(depth: Column, place: Column, begins: bool) -> Column:
            return F.struct(depth.alias("depth"), place.alias("i"), F.lit(begins).alias("begins"))

        starting = F.filter(others, lambda x: _starts_stage(marks, x["i"]))
        pipes = F.filter(others, lambda x: x["v"] == "|")
        closing = F.filter(brackets, lambda b: b["v"] == "]")
        events = F.sort_array(
            F.concat(
                F.transform(starting, lambda x: event(x["depth"], x["i"], True)),
                F.transform(pipes, lambda x: event(x["depth"], x["i"], False)),
                F.transform(closing, lambda b: event(b["before"], b["i"], False)),
                F.array(event(F.lit(0), F.size(marks), False)),
            )
        )

        def matched(ordered: Column) -> Column:
            def span(e: Column, n: Column) -> Column:
                end = F.get(ordered, n + 1)["i"]
                return F.when(e["begins"], F.struct(e["i"].alias("begin"), e["depth"].alias("depth"), end.alias("end")))

            return F.filter(F.transform(ordered, span), lambda found: found.isNotNull())

        return F.sort_array(_let(events, matched))

    return _with_depths(marks, spans)


def _canonical(text: Column) -> Column:
    """Runs of whitespace become one blank, except inside quotes and macros."""

    def collapse(part: Column) -> Column:
        return F.regexp_replace(part, r"\s+", " ")

    parts = _pieces(text, rf'(?s){_QUOTED}|{_MACRO}|[^"`]++')
    kept = F.transform(parts, lambda p: F.when(p.startswith('"') | p.startswith("`"), p).otherwise(collapse(p)))
    return F.when(text.contains('"') | text.contains("`"), F.array_join(kept, "")).otherwise(collapse(text))


def stages(text: Column) -> Column:
    """Every stage at every depth, ordered by where it starts.

    ``array<struct<position, depth, command, token_class, args, stage_text, stage_key, piped_on>>``. ``stage_text`` is
    the source text of the stage, subsearches included; ``stage_key`` its canonical form; ``piped_on`` tells whether a
    pipe follows anywhere after it.
    """

    def describe(position: Column, depth: Column, stage_text: Column, word: Column, piped_on: Column) -> Column:
        return F.struct(
            position.alias("position"),
            depth.alias("depth"),
            F.lower(word).alias("command"),
            _word_class(word).alias("token_class"),
            _strip(F.substr(stage_text, F.length(word) + 1)).alias("args"),
            stage_text.alias("stage_text"),
            F.concat(F.lower(word), _canonical(F.substr(stage_text, F.length(word) + 1))).alias("stage_key"),
            piped_on.alias("piped_on"),
        )

    def build(segments: Column, marks: Column, pipes_end: Column) -> Column:
        def stage(span: Column, position: Column) -> Column:
            single = (span["end"] - span["begin"]) == 1
            joined = _strip(F.array_join(F.slice(segments, span["begin"] + 1, span["end"] - span["begin"]), ""))
            whole = F.when(single, F.get(marks, span["begin"])).otherwise(joined)
            named = F.struct(whole.alias("text"), _first_word(F.get(marks, span["begin"])).alias("word"))
            return _let(
                named,
                lambda s: describe(position, span["depth"], s["text"], s["word"], pipes_end > span["end"]),
            )

        spans = F.when(_has_brackets(text), _nested_spans(marks)).otherwise(_flat_spans(marks))
        return F.transform(spans, stage)

    def pipes_end(marks: Column) -> Column:
        """Number of segments up to and including the last pipe, 0 without any."""
        from_back = F.array_position(F.reverse(marks), F.lit("|"))
        return F.when(from_back > 0, F.size(marks) - from_back + 1).otherwise(0)

    return _let(
        _pieces(text, SEGMENT),
        lambda segments: _let(
            _marks(segments),
            lambda marks: F.when(
                _is_well_formed(text, marks), _let(pipes_end(marks), lambda p: build(segments, marks, p))
            ),
        ),
    )


def categories(text: Column) -> Column:
    """T4: the category of every stage, in order. Only texts that hold ``addtotals`` need more of a stage than its word."""
    by_word = F.transform(command_words(text), lambda w: stage_category(w["value"], w["token_class"], F.lit("")))
    by_stage = F.transform(stages(text), lambda s: stage_category(s["command"], s["token_class"], s["args"]))
    return F.when(F.lower(text).contains("addtotals"), by_stage).otherwise(by_word)


def text_digest(text: Column) -> Column:
    """A 32-byte key that stands for a text in shuffles, so that long texts travel once."""
    return F.unhex(F.sha2(text, 256))
