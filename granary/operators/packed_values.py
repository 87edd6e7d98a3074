"""Several values packed in one field -> one value per row, with position.

A finite-state tokenizer walks each field once. Its state is (inside which
quote, nesting depth, at a value's start or not), so that a delimiter counts
only outside quotes and brackets.

Rules
-----
* Delimiters: ``; | , / & tab newline`` and the bullets ``• ·``; `` - `` only
  if `dash` is set, and the words in `words` where white space stands on both
  sides.
* A quote opens only at a value's start, and closes it only where a delimiter
  or the end follows, so an inner nickname in quotes stays part of the value.
  A quote that never closes is an ordinary character. A doubled quote or a
  backslash before a quote stands for the quote itself.
* Nothing in quotes or in parentheses is split. Brackets around the whole field
  (an array literal) are peeled off.
* List numbers (``1.`` ``2)`` ``(3)``) at a value's start are dropped; a list
  number that continues a numbered field (1, 2, 3, ...) also starts a value.
* At a value's start a name from `names` is taken whole, letter case aside
  (longest first), if a delimiter, a quote or the end follows.
* Empty slots take no position. Null and blank fields give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELIMITERS = ";|,/&\t\r\n•·"
QUOTES = {'"': '"', "“": "”", "”": "”", "„": "“", "«": "»", "'": "'", "‘": "’"}
NUMBER = re.compile(r"\(?(\d{1,3})[.)](?=\s|$|[^\d\s])\s*")
MAX_NAMES = 100_000


class Names:
    """Longest match of known names at a position, letter case aside."""

    def __init__(self, names: Iterable[str]):
        self.by_start: dict[str, list[str]] = {}
        for n in {n.strip().lower() for n in names if n and n.strip()}:
            self.by_start.setdefault(n[:2], []).append(n)
        for v in self.by_start.values():
            v.sort(key=len, reverse=True)

    def at(self, lowered: str, i: int, ends) -> int:
        for n in self.by_start.get(lowered[i : i + 2], ()):
            if lowered.startswith(n, i) and ends(i + len(n)):
                return len(n)
        return 0


def split_values(field: str | None, names: Names | None = None, dash: bool = False, words: Sequence[str] = ()) -> list[str]:
    """The values of one field, in order (see the module's rules)."""
    if field is None:
        return []
    s = field.strip()
    if len(s) > 1 and s[0] == "[" and s[-1] == "]":
        s = s[1:-1]
    n, low = len(s), s.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in s)
    numbered = bool(NUMBER.match(s))

    def word_at(i: int) -> int:
        """Length of a delimiting word or spaced dash at i, which is a space."""
        if dash and s.startswith(" - ", i):
            return 3
        for w in words:
            if low.startswith(w, i + 1) and i + 1 + len(w) < n and s[i + 1 + len(w)].isspace():
                return 1 + len(w)
        return 0

    def ends(i: int) -> bool:
        """Whether a value may end before i."""
        j = i
        while j < n and s[j] == " ":
            j += 1
        if j >= n or s[j] in DELIMITERS:
            return True
        if j > i and (word_at(j - 1) or numbered and NUMBER.match(s, j)):
            return True
        return False

    out: list[str] = []
    i, count = 0, 0
    while i < n:
        c = s[i]
        if c.isspace() or c in DELIMITERS:
            i += word_at(i) or 1 if c == " " else 1
            continue
        m = NUMBER.match(s, i) if numbered else None
        if m and int(m[1]) == count + 1:
            count += 1
            i = m.end()
            continue
        if c in QUOTES:
            close, j, buf = QUOTES[c], i + 1, []
            while j < n:
                d = s[j]
                if d == "\\" and j + 1 < n and s[j + 1] in ('"', "'", "\\"):
                    buf.append(s[j + 1])
                    j += 2
                elif d == close and c == close and s.startswith(close, j + 1):
                    buf.append(d)
                    j += 2
                elif d == close and ends(j + 1):
                    break
                else:
                    buf.append(d)
                    j += 1
            if j < n:
                v = "".join(buf).strip()
                if v:
                    out.append(v)
                i = j + 1
                continue
        k = names.at(low, i, ends) if names else 0
        if k:
            out.append(s[i : i + k])
            i += k
            continue
        start, depth, inner = i, 0, ""
        while i < n:
            c = s[i]
            if inner:
                if c == inner:
                    inner = ""
            elif c == "(" and s.find(")", i) > 0:
                depth += 1
            elif c == ")" and depth:
                depth -= 1
            elif not depth:
                if c in DELIMITERS:
                    break
                if c in '"“«' and s.find(QUOTES[c], i + 1) > 0:
                    inner = QUOTES[c]
                elif c == " ":
                    m = NUMBER.match(s, i + 1) if numbered else None
                    if word_at(i) or m and int(m[1]) == count + 1:
                        break
            i += 1
        v = s[start:i].strip()
        if v:
            out.append(v)
    return out


def explode_packed(df: DataFrame, key: str, fields: dict[str, dict]) -> DataFrame:
    """Distinct (key, field_name, pos, val) of the packed `fields` of `df`.

    `fields` maps a column to options: `names` (list of atoms), `dash`,
    `words`. Repeated rows of one key with the same text give one set of rows;
    if their texts differ, the rows of every text are given. Empty tables give
    no rows. Columns of `df` beyond these are not read.
    """
    for o in fields.values():
        if len(o.get("names", ())) > MAX_NAMES:
            raise ValueError("too many names to ship to every task")
    kind = df.schema[key].dataType.simpleString()
    options = {f: {**o, "names": list(o.get("names", ()))} for f, o in fields.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {f: {**o, "names": Names(o["names"]) if o["names"] else None} for f, o in options.items()}
        known: dict[tuple[str, str], list[str]] = {}
        for b in batches:
            keys, names, pos, vals = [], [], [], []
            src = b.column(0).to_pylist()
            for j, (f, o) in enumerate(ready.items()):
                for k, text in zip(src, b.column(j + 1).to_pylist()):
                    if not text:
                        continue
                    got = known.get((f, text))
                    if got is None:
                        got = split_values(text, **o)
                        if len(known) < 50_000:  # memory of one task; only saves time
                            known[f, text] = got
                    keys += [k] * len(got)
                    names += [f] * len(got)
                    pos += range(1, len(got) + 1)
                    vals += got
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(names, pa.string()), pa.array(pos, pa.int32()), pa.array(vals, pa.string())], ["k_", "field_name", "pos", "val"])

    read = df.select(F.col(key), *fields).filter(" or ".join(f"`{f}` is not null" for f in fields))
    out = read.mapInArrow(run, f"k_ {kind}, field_name string, pos int, val string")
    return out.withColumnRenamed("k_", key).distinct()
