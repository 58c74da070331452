"""Kernels over the lines of patches, as columns. A null patch counts as an empty one.

Patterns see words, blanks and cases as Unicode has them, and only line feeds end lines within them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce
from re import _constants as _re
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a line where lines are split at every kind of break; what is cut off at the ends of a line.
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Breaks but line feeds: a class of one table of bits, and those beyond it, as a class of both is several times as slow.
RARE_BREAKS, FAR_BREAKS = "[\r\x0b\x0c\x1c\x1d\x1e\x85]", ("\u2028", "\u2029")
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def pattern(p: str, ignore_case: bool = False, lines: bool = False) -> Column:
    return F.lit("(?dU" + "i" * ignore_case + "m" * lines + ")" + p)


def anywhere(p: str) -> str:
    """A pattern that is looked for anywhere in a line: what may stand before it needn't be tried."""
    return p.removeprefix(".*")


def _words(parsed) -> list[str]:
    """Of a parsed pattern: words of which every match holds one; the longest that are told, four at most if possible."""
    found, run = [], ""
    for op, of in [*parsed, (None, None)]:
        if op is _re.LITERAL:
            run += chr(of)
            continue
        found, run = [*found, [run]] if run else found, ""
        if op is _re.SUBPATTERN and not of[1] and not of[2]:
            found.append(_words(of[3]))
        elif op is _re.BRANCH:
            each = [_words(x) for x in of[1]]
            ws = dict.fromkeys(sum(each, [])) if all(each) else {}
            found.append([w for w in ws if not any(v != w and v in w for v in ws)])
        elif op in (_re.MAX_REPEAT, _re.MIN_REPEAT) and of[0] > 0:
            found.append(_words(of[2]))
    return max(filter(None, reversed(found)), key=lambda ws: (len(ws) <= 4, min(map(len, ws)), -len(ws)), default=[])


@lru_cache(maxsize=None)
def needed(p: str) -> list[str]:
    """Words of which every match of the pattern holds one; none where no such words are told."""
    try:
        parsed = _parser.parse(p)
    except re.error:  # not all patterns are Python's, too
        return []
    words = _words(parsed)
    return [] if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) or not all(map(str.isascii, words)) else words


def lowered(text: Column) -> Column:
    """A plain ASCII text in lower case; null for others, as some other letters have ASCII ones as their other case."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text))


def lacks(text: Column, p: str, ignore_case: bool = False, low: Column | None = None) -> Column | None:
    """Whether the text is known to lack what every match of the pattern needs: cheaper to tell than that there's no match. None if the pattern tells no such words.

    low: lowered(text), where it is a column.
    """
    words = needed(p)
    if not words:
        return None
    if ignore_case:
        text, words = lowered(text) if low is None else low, [w.lower() for w in words]
    return ~reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def matches(text: Column, p: str, ignore_case: bool = False, lines: bool = False, low: Column | None = None) -> Column:
    """Whether the pattern is found; null in a null text."""
    found, no = F.regexp_like(text, pattern(p, ignore_case, lines)), lacks(text, p, ignore_case, low)
    return found if no is None else F.when(no, F.lit(False)).otherwise(found)


def lines(patch: Column, every_break: bool = False) -> Column:
    """The lines of a text, split at line feeds, or at every kind of line break."""
    text = F.coalesce(patch, F.lit(""))
    plain = F.split(text, "\n", -1)
    if not every_break:
        return plain
    far = (F.octet_length(text) != F.char_length(text)) & reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in FAR_BREAKS])
    return F.when(F.regexp_like(text, F.lit(RARE_BREAKS)) | far, F.split(text, BREAKS, -1)).otherwise(plain)


def is_marked(line: Column, mark: str = "+") -> Column:
    """Whether a line starts with mark, but not three times."""
    return line.startswith(mark) & ~line.startswith(mark * 3)


def marked(patch: Column, mark: str = "+", headers: bool = False, every_break: bool = False) -> Column:
    """Lines that start with mark; file headers, where it stands three times, only if asked for."""
    return F.filter(lines(patch, every_break), lambda x: x.startswith(mark) if headers else is_marked(x, mark))


def unmarked(found: Column, mark: str = "+") -> Column:
    return F.transform(found, lambda x: F.substr(x, F.lit(len(mark) + 1)))


def marked_text(patch: Column, mark: str = "+", keep_mark: bool = False, headers: bool = False, every_break: bool = False) -> Column:
    """Those lines as one text, without their marks unless keep_mark."""
    found = marked(patch, mark, headers, every_break)
    return F.array_join(found if keep_mark else unmarked(found, mark), "\n")


def stripped(line: Column) -> Column:
    """A marked line without its mark and without blanks at its ends."""
    x, blanks = F.substr(line, F.lit(2)), F.lit(BLANKS)
    return F.when(F.contains(blanks, F.left(x, F.lit(1))) | F.contains(blanks, F.right(x, F.lit(1))), F.btrim(x, blanks)).otherwise(x)


def occurrences(text: Column, p: str, ignore_case: bool = False, lines: bool = False, low: Column | None = None) -> Column:
    n, no = F.coalesce(F.regexp_count(text, pattern(p, ignore_case, lines)), F.lit(0)).cast("bigint"), lacks(text, p, ignore_case, low)
    return n if no is None else F.when(no, F.lit(0).cast("bigint")).otherwise(n)


def catalogue_counts(text: Column, catalogue: dict[str, str], ignore_case: bool = True) -> dict[str, Column]:
    return {name: occurrences(text, p, ignore_case) for name, p in catalogue.items()}


def each_text(*texts: Column) -> Column:
    """For each text a struct of it (t) and lowered() of it (low).

    Long lists of patterns are evaluated in lambdas over these: written out in a plan, their generated method grows past
    what the JVM compiles (8000 bytes), and is interpreted for each row.
    """
    return F.array(*[F.struct(t.alias("t"), lowered(t).alias("low")) for t in texts])


def counted(text: Column, catalogue: dict[str, str], ignore_case: bool = True) -> Column:
    """catalogue_counts as one struct: to be a column of its own before its fields are taken."""
    return F.transform(each_text(text), lambda x: F.struct(*[occurrences(x["t"], p, ignore_case, low=x["low"]).alias(n) for n, p in catalogue.items()]))[0]


def total_and_unique(names: list[str]) -> tuple[Column, Column]:
    """Of counted features the sum, and how many occur at all."""
    return reduce(lambda a, b: a + b, map(F.col, names)), reduce(lambda a, b: a + b, [(F.col(n) > 0).cast("bigint") for n in names])


def any_match(text: Column, patterns: list[str], ignore_case: bool = False, lines: bool = False, low: Column | None = None) -> Column:
    """Whether one of the patterns is found; in a null text none is. lines: ^ and $ stand at the ends of lines, too."""
    made = [p if lines else anywhere(p) for p in patterns]
    return reduce(lambda a, b: a | b, [F.coalesce(matches(text, p, ignore_case, lines, low), F.lit(False)) for p in made])


def any_line_match(patch: Column, patterns: list[str], found: Column | None = None) -> Column:
    """Whether an added line of the patch, without mark and outer blanks, holds one of the patterns. found: the added lines, where these are a column."""
    return F.exists(F.transform(marked(patch, every_break=True) if found is None else found, stripped), lambda x: any_match(x, patterns))


def score_text(text: Column, scored: list[tuple[str, int]]) -> Column:
    """The sum of the scores of the patterns that the text matches in either case; a null text scores 0."""
    each = lambda x: reduce(lambda a, b: a + b, [F.when(matches(x["t"], p, True, low=x["low"]), n).otherwise(0) for p, n in scored])
    return F.transform(each_text(text), each)[0].cast("bigint")


def score_patch(patch: Column, scored: list[tuple[str, int]], line: Callable[[Column], Column] | None = None, found: Column | None = None) -> Column:
    """The sum, over added lines (as line() gives them), of the score of the first pattern that each matches. found: the added lines, where these are a column."""
    def first(x: Column) -> Column:
        return reduce(lambda rest, ps: F.when(matches(x, anywhere(ps[0])), F.lit(ps[1])).otherwise(rest), reversed(scored), F.lit(0))

    found = marked(patch, every_break=True) if found is None else found
    return F.aggregate(F.transform(found, line) if line else found, F.lit(0).cast("bigint"), lambda a, x: a + first(x))


def followed_by(patch: Column, first, second) -> Column:
    """How many lines for which first holds are followed by a line for which second holds."""
    rows = lines(patch)
    pairs = F.zip_with(F.slice(rows, F.lit(1), F.size(rows) - 1), F.slice(rows, F.lit(2), F.size(rows)), lambda a, b: (first(a) & second(b)).cast("bigint"))
    return F.when(F.size(rows) > 1, F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))


def type_to_any(patch: Column, any_pattern: str) -> Column:
    """How many removed lines with a colon and no 'any' are followed by a line that starts with the added mark and holds the pattern."""
    typed = lambda x: x.startswith("-") & ~x.startswith("---") & x.contains(":") & ~F.lower(x).contains("any")
    return followed_by(patch, typed, lambda x: x.startswith("+") & F.regexp_like(x, pattern(any_pattern)))


def header_sums(patch: Column, read: tuple[Column, Column] | None = None) -> tuple[Column, Column, Column]:
    """Additions and deletions that headers '=== name (+a/-d) ===' state (or, if these add up to none, the marked lines), and the number of names. read: as names_file()."""
    rows, named = read or (lines(patch), header_names(patch))
    heads = F.filter(rows, is_header)

    def numbers(i: int) -> Column:
        return F.aggregate(heads, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(F.nullif(F.regexp_extract(x, r"\(\+(\d+)/-(\d+)\)", i), F.lit("")).cast("bigint"), F.lit(0)))

    plus, minus = numbers(1), numbers(2)
    stated = (plus + minus) > 0
    names = F.array_distinct(F.filter(named, lambda x: x != ""))
    count = lambda mark: F.size(F.filter(rows, lambda x: is_marked(x, mark))).cast("bigint")
    return F.when(stated, plus).otherwise(count("+")), F.when(stated, minus).otherwise(count("-")), F.size(names).cast("bigint")


def has_suffix(name: Column, suffixes: list[str], generated: list[str] = ()) -> Column:
    """Whether a path's last part ends in one of the suffixes, in any case, and isn't generated; null: false.

    generated: endings (they begin with a dot) and whole names, in just that case.
    """
    base, low = F.substring_index(name, "/", -1), F.lower(name)
    good = reduce(lambda a, b: a | b, [low.endswith(s) & (F.length(base) > len(s)) for s in suffixes])
    bad = reduce(lambda a, b: a | b, [name.endswith(g) if g.startswith(".") else base == g for g in generated], F.lit(False))
    return F.coalesce(good & ~bad, F.lit(False))


def count_in_lines(found: Column, p: str, ignore_case: bool = False) -> Column:
    """How often a pattern occurs in the lines, none of the matches across two."""
    return F.aggregate(found, F.lit(0).cast("bigint"), lambda n, x: n + occurrences(x, p, ignore_case))


def is_header(line: Column) -> Column:
    return line.startswith("===") & line.endswith("===")


def header_names(patch: Column, rows: Column | None = None) -> Column:
    """What stands in lines '=== name (...) ===', in order, as often as it does. rows: the patch's lines, where these are a column."""
    heads = F.filter(lines(patch) if rows is None else rows, is_header)
    return F.transform(heads, lambda x: F.btrim(F.substring_index(F.coalesce(F.get(F.split(x, "===", -1), F.lit(1)), F.lit("")), "(", 1), F.lit(BLANKS)))


def with_lines(df: DataFrame, patch: str) -> DataFrame:
    """df with a patch's lines as rows and its header_names as names, so that what asks for them several times splits the patch once."""
    return df.withColumn("rows", lines(F.col(patch))).withColumn("names", header_names(F.col(patch), F.col("rows")))


def names_file(patch: Column, suffixes: list[str], generated: list[str] = (), first: int = 50, read: tuple[Column, Column] | None = None) -> Column:
    """Whether a header names a file of these suffixes, or else one of the first lines that name files holds a suffix and nothing generated.

    read: the patch's lines and header_names, where these are columns.
    """
    rows, named = read or (lines(patch), header_names(patch))
    holds = lambda x, parts: reduce(lambda a, b: a | b, [x.contains(s) for s in parts], F.lit(False))
    names = lambda x: x.startswith("diff --git") | x.startswith("---") | x.startswith("+++")
    told = F.exists(F.slice(rows, 1, first), lambda x: names(x) & holds(x, suffixes) & ~holds(x, generated))
    return F.exists(named, lambda x: has_suffix(x, suffixes, generated)) | told


def file_count(patch: Column, suffixes: list[str], generated: list[str] = (), from_diffs: bool = False, read: tuple[Column, Column] | None = None) -> Column:
    """How many different files of these suffixes headers name; where they name none and from_diffs, lines 'diff --git a/x b/x'. read: as names_file()."""
    rows, names = read or (lines(patch), header_names(patch))
    valid = lambda x: has_suffix(x, suffixes, generated)
    named = F.size(F.array_distinct(F.filter(names, valid))).cast("bigint")
    if not from_diffs:
        return named
    parts = F.transform(F.filter(rows, lambda x: x.startswith("diff --git")), lambda x: F.get(F.split(F.btrim(x, F.lit(BLANKS)), r"\s+"), F.lit(3)))
    told = F.transform(F.filter(parts, lambda x: x.isNotNull()), lambda x: F.when(x.startswith("b/"), F.substr(x, F.lit(3))).otherwise(x))
    return F.when(named > 0, named).otherwise(F.size(F.array_distinct(F.filter(told, valid))).cast("bigint"))
