"""Several values packed in one field: one row per value, with its place in the field.

A finite-state tokenizer walks the field once. Its state is (open quote, bracket depth); a separator counts only
outside quotes and at depth 0, and a bracket only outside quotes and escapes. Runs of ordinary characters are skipped by
compiled patterns, so the walk takes a step per special character and not per character. Inside a quote the way on
depends on the place alone, so places from which no quote closes are remembered and never walked again; brackets are
matched by one walk with a stack. The work thus grows with the length of the field, whatever it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate values wherever they stand outside quotes and round brackets.
SEPARATORS = ",;|\n\r\t，；、｜"
#: Opening quotes and what closes them.
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "”", "‘": "’", "«": "»", "「": "」"}
#: List brackets that may stand around a whole field.
LISTS = {"[": "]", "{": "}"}
ROUND = {"(": ")", "（": "）"}
#: Escapes that stand for another character than the one after the backslash.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
#: What a field must hold to be able to have two values; the scan filters with it before any Python runs.
MAY_SPLIT = "[,;|\\n\\r\\t，；、｜]|\\s/|/\\s"

_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff"
_SPACE = " \t\n\r\f\v\u00a0" + _INVISIBLE
_PLAIN = re.compile(r"[^,;|\n\r\t，；、｜/\\\"'“„‘«「(（]+")
_SIMPLE = re.compile(r"[,;|\n\r\t，；、｜]|(?<=\s)/|/(?=\s)")
_HARD = re.compile(r"[\\\"'“„‘«「(（\[{]")
_CLOSING = frozenset(ROUND.values())
_INNER = re.compile(r"[^,;|\n\r\t，；、｜/\\\"'“„‘«「(（)）]+")
_LISTED = re.compile(r"[\[\]{}]")
#: What matters inside a quote: what closes it, and escapes.
_MARKS = {close: re.compile(f"[{close}\\\\]") for close in QUOTES.values()}
_HEX = re.compile(r"u([0-9a-fA-F]{4})")


def _trim(text: str) -> str:
    return text.strip().strip(_SPACE)


def _escaped(s: str, i: int) -> tuple[str, int]:
    """The character an escape at s[i] == '\\' stands for, and where the text goes on."""
    if m := _HEX.match(s, i + 1):
        code, end = int(m[1], 16), m.end()
        if 0xD800 <= code < 0xDC00 and s[end : end + 1] == "\\" and (low := _HEX.match(s, end + 1)):
            second = int(low[1], 16)
            if 0xDC00 <= second < 0xE000:
                return chr(0x10000 + ((code - 0xD800) << 10) + second - 0xDC00), low.end()
        return ("�" if 0xD800 <= code < 0xE000 else chr(code)), end
    if i + 1 == len(s):
        return "\\", i + 1
    return s[i + 1], i + 2


class _Field:
    """The quotes and round brackets of one field."""

    def __init__(self, s: str):
        self.s = s
        self.dead: dict[tuple[str, bool], set[int]] = {}
        self._brackets: dict[int, int] | None = None

    def slash_splits(self, i: int) -> bool:
        """Whether a slash at i stands beside a space or at the end."""
        s = self.s
        return (i > 0 and s[i - 1].isspace()) or i + 1 == len(s) or s[i + 1].isspace()

    def ends(self, i: int, inside: bool) -> bool:
        """Whether a value can end at i: at the end, or with a separator next, spaces aside; inside round brackets also where they close."""
        s, n = self.s, len(self.s)
        while i < n and s[i] in _SPACE:
            if s[i] in SEPARATORS:
                return True
            i += 1
        return i == n or s[i] in SEPARATORS or (inside and s[i] in _CLOSING) or (s[i] == "/" and self.slash_splits(i))

    def quoted(self, i: int, inside: bool = False) -> tuple[str, int] | None:
        """The value quoted from i on and the place after its closing quote; None if no quote closes it."""
        s, n = self.s, len(self.s)
        close, out, i = QUOTES[s[i]], [], i + 1
        mark = _MARKS[close]
        dead, walked = self.dead.setdefault((close, inside), set()), []
        while m := mark.search(s, i):
            at = m.start()
            if at in dead:
                break
            walked.append(at)
            if at > i:
                out.append(s[i:at])
            if s[at] == "\\":
                if s[at + 1 : at + 2] in ESCAPES:
                    out.append(ESCAPES[s[at + 1]])
                    i = at + 2
                else:
                    got, i = _escaped(s, at)
                    out.append(got)
            elif s[at + 1 : at + 2] == close:
                out.append(close)
                i = at + 2
            elif self.ends(at + 1, inside):
                return "".join(out), at + 1
            else:
                out.append(close)
                i = at + 1
        dead.update(walked)
        return None

    def rounded(self, i: int) -> int | None:
        """The place after the bracket that closes the one at i; None if none does."""
        if self._brackets is None:
            self._brackets = self._matched()
        return self._brackets.get(i)

    def _matched(self) -> dict[int, int]:
        s, n, i, fresh = self.s, len(self.s), 0, True
        ends: dict[int, int] = {}
        open_: dict[str, list[int]] = {c: [] for c in ROUND.values()}
        deep = 0
        while i < n:
            if m := _INNER.match(s, i):
                fresh = fresh and not m[0].strip(_SPACE)
                i = m.end()
                continue
            c = s[i]
            if c == "\\":
                fresh, i = False, i + 2
            elif c in ROUND:
                open_[ROUND[c]].append(i)
                deep, fresh, i = deep + 1, True, i + 1
            elif c in _CLOSING:
                if open_[c]:
                    ends[open_[c].pop()] = i + 1
                    deep -= 1
                fresh, i = False, i + 1
            elif fresh and c in QUOTES and (got := self.quoted(i, deep > 0)):
                fresh, i = False, got[1]
            else:
                fresh, i = c in SEPARATORS or (c == "/" and self.slash_splits(i)), i + 1
        return ends


def _unlisted(s: str) -> str:
    """s without list brackets that stand around the whole of it."""
    if len(s) < 2 or LISTS.get(s[0]) != s[-1]:
        return s
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {c: [] for c in LISTS.values()}
    for m in _LISTED.finditer(s):
        if m[0] in LISTS:
            open_[LISTS[m[0]]].append(m.start())
        elif open_[m[0]]:
            ends[open_[m[0]].pop()] = m.start()
    a, b = 0, len(s)
    while b - a > 1 and LISTS.get(s[a]) == s[b - 1] and ends.get(a) == b - 1:
        a, b = a + 1, b - 1
        while a < b and (s[a].isspace() or s[a] in _SPACE):
            a += 1
        while a < b and (s[b - 1].isspace() or s[b - 1] in _SPACE):
            b -= 1
    return s[a:b]


def split_packed(field: str | None) -> list[str]:
    """The non-empty values of a field in their order.

    Null, empty and blank fields give none. Repeated values are kept. A quote that nothing closes and a round bracket
    that nothing closes are ordinary characters.
    """
    if not field:
        return []
    if not _HARD.search(field):
        return [v for x in _SIMPLE.split(field) if (v := _trim(x))]
    s = _unlisted(_trim(field))
    quotes = _Field(s)
    values: list[str] = []
    out: list[str] = []
    i, n, fresh = 0, len(s), True

    def close() -> None:
        if value := _trim("".join(out)):
            values.append(value)
        out.clear()

    while i < n:
        if m := _PLAIN.match(s, i):
            run = m[0]
            if not fresh or run.strip(_SPACE):
                out.append(run)
                fresh = False
            i = m.end()
            continue
        c = s[i]
        if c in SEPARATORS:
            close()
            fresh, i = True, i + 1
        elif c == "/":
            if quotes.slash_splits(i):
                close()
                fresh, i = True, i + 1
            else:
                out.append(c)
                fresh, i = False, i + 1
        elif c == "\\":
            got, i = _escaped(s, i)
            out.append(got)
            fresh = False
        elif c in ROUND and (end := quotes.rounded(i)):
            out.append(s[i:end])
            fresh, i = False, end
        elif fresh and c in QUOTES and (got := quotes.quoted(i)):
            out.append(got[0])
            fresh, i = False, got[1]
        else:
            out.append(c)
            fresh, i = False, i + 1
    close()
    return values


def explode_packed(
    df: DataFrame,
    column: str,
    keep: Sequence[str] = (),
    pos_col: str = "pos",
    item_col: str = "item",
    min_values: int = 1,
) -> DataFrame:
    """One row per value of df[column], with the columns keep, the value's place from 1 on and the value.

    Fields of fewer than min_values values give no row, so null and empty ones never do; an empty df gives an empty
    result. Repeated rows are each split. A kept column that is named as pos_col or item_col comes out with "_in"
    appended. Narrow: no shuffle; with min_values above 1 the scan drops fields that hold no separator at all.
    """
    names = {c: c + "_in" if c in (pos_col, item_col) else c for c in keep}
    source = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(f"`{column}`").cast("string").alias("__field"))
    source = source.where(F.col("__field").rlike(MAY_SPLIT)) if min_values > 1 else source.where(F.col("__field").isNotNull())
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(pos_col, T.IntegerType()), T.StructField(item_col, T.StringType())])
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, pos, item = [], [], []
            for i, field in enumerate(batch.column(width).to_pylist()):
                values = split_packed(field)
                if len(values) >= min_values:
                    index += [i] * len(values)
                    pos += range(1, len(values) + 1)
                    item += values
            kept = [batch.column(j).take(pa.array(index, pa.int64())) for j in range(width)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(pos, pa.int32()), pa.array(item, pa.string())], [*batch.schema.names[:-1], pos_col, item_col])

    return source.mapInArrow(run, schema)


def packed_found(statements: DataFrame, word_statements: DataFrame) -> DataFrame:
    """The values of every correct_object_2 of both statement tables that holds at least two, each row_id once."""
    both = statements.select("row_id", "correct_object_2", "ingested_at").unionByName(word_statements.select("row_id", "correct_object_2", "ingested_at"))
    once = (
        both.where(F.col("correct_object_2").rlike(MAY_SPLIT))
        .groupBy("row_id")
        .agg(F.min_by("correct_object_2", F.struct("ingested_at", "correct_object_2")).alias("correct_object_2"))
    )
    return explode_packed(once, "correct_object_2", ["row_id"], min_values=2)
