"""Text that looks right but is coded in another way -> one consistent form.

Every Arrow partition runs through an embedded DuckDB: texts with a sign beyond
the usual ones are picked by a regular expression, then `translate` maps
spaces, full-width and styled forms, invisible signs are removed,
`nfc_normalize` composes accents, and words that mix Latin with look-alike
letters of other scripts are mapped to Latin.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.words import INVISIBLE, LOOKALIKES, STROKED

#: Spaces that are not the plain one, and line ends that are not the plain one.
SPACES = [0x0B, 0x0C, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
LINE_ENDS = [0x85, 0x2028, 0x2029]
#: Signs taken for a usual sign.
SIGNS = {0x2010: "-", 0x2011: "-", 0x2024: ".", 0x2236: ":", 0x037E: ";"}
#: Control signs, which print nothing.
CONTROLS = [*range(0x01, 0x09), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0)]
TAGS = range(0xE0001, 0xE0080)
#: Ranges whose compatibility form looks the same: full width, styled letters, letterlike signs, Roman numerals, ligatures, digraphs.
SAME_LOOK = [(0xFF01, 0xFFDD), (0xFFE0, 0xFFE7), (0x1D400, 0x1D800), (0x2160, 0x2180), (0xFB00, 0xFB07), (0x01C4, 0x01CD), (0x01F1, 0x01F4), (0x0132, 0x0134), (0x2102, 0x2103), (0x210A, 0x2116), (0x2119, 0x211E), (0x2124, 0x2125), (0x212A, 0x212E)]


def compatibility_forms() -> dict[str, str]:
    """Signs of SAME_LOOK and the usual letters they stand for, by Unicode's own rule."""
    out = {}
    for a, b in SAME_LOOK:
        for c in range(a, b):
            ch = chr(c)
            form = unicodedata.normalize("NFKC", ch)
            kind = unicodedata.decomposition(ch).split(" ")[0]
            if form != ch and kind in ("<wide>", "<narrow>", "<font>", "<compat>") or kind and kind[0] != "<" and form != ch:
                out[ch] = form
    return out


def lookalikes() -> dict[str, str]:
    """LOOKALIKES and their composed forms with one accent."""
    out = dict(LOOKALIKES)
    for a, b in LOOKALIKES.items():
        for m in map(chr, (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x308, 0x309, 0x30B, 0x31B, 0x323, 0x327)):
            x, y = unicodedata.normalize("NFC", a + m), unicodedata.normalize("NFC", b + m)
            if len(x) == len(y) == 1:
                out[x] = y
    return out


def _class(chars) -> str:
    return "".join(f"\\x{{{ord(c) if isinstance(c, str) else c:X}}}" for c in chars)


def _usual() -> str:
    """A character class of what needs no look: ASCII, composed Latin letters, common signs."""
    latin = [chr(c) for a, b in ((0xC0, 0x180), (0x1A0, 0x1A2), (0x1AF, 0x1B1), (0x1EA0, 0x1EFA)) for c in range(a, b) if chr(c) not in STROKED]
    latin = [c for c in latin if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFKC", c) == c]
    return r"\t\n\r\x20-\x7E" + _class([*latin, *"«»“”‘’„–—…•·²³°§©®™×÷±€£½¼¾№≤≥≠→←"])


def consistent_sql(fields: list[str]) -> str:
    """SQL over the view `batch` (columns k0, f0, f1, ...): k0, form0, form1, ..."""
    forms = compatibility_forms()
    single = {**{c: f for c, f in forms.items() if len(f) == 1}, **{chr(c): " " for c in SPACES}, **{chr(c): "\n" for c in LINE_ENDS}, **{chr(c): s for c, s in SIGNS.items()}, **STROKED}
    several = {c: f for c, f in forms.items() if len(f) > 1}
    q = lambda s: "'" + s.replace("'", "''") + "'"
    alike = lookalikes()
    foreign, latin = "".join(alike), "".join(alike.values())
    gone = _class([*INVISIBLE, *CONTROLS]) + f"\\x{{{TAGS[0]:X}}}-\\x{{{TAGS[-1]:X}}}"

    def form(x: str) -> str:
        swapped = x
        for c, f in several.items():
            swapped = f"replace({swapped}, {q(c)}, {q(f)})"
        several_class = _class(several)
        mapped = f"translate(CASE WHEN regexp_matches({x}, '[{several_class}]') THEN {swapped} ELSE {x} END, {q(''.join(single))}, {q(''.join(single.values()))})"
        return f"regexp_replace({mapped}, '[{gone}]', '', 'g')"

    def solid(t: str) -> str:
        """Whether the word has a letter of another script that looks like no Latin one."""
        return f"regexp_matches(translate({t}, {q(foreign)}, ''), '[\\p{{Greek}}\\p{{Cyrillic}}]')"

    def words(x: str) -> str:
        parts = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}\\p{{N}}]+|[^\\p{{L}}\\p{{M}}\\p{{N}}]+')"
        looks = f"regexp_matches(t, '[{_class(alike)}]') AND NOT {solid('t')}"
        near = f"(regexp_matches(t, '\\p{{Latin}}') OR NOT ({solid('coalesce(parts[i - 2], chr(32))')} OR {solid('coalesce(parts[i + 2], chr(32))')}))"
        fixed = f"array_to_string(list_transform(parts, lambda t, i: CASE WHEN {looks} AND {near} THEN translate(t, {q(foreign)}, {q(latin)}) ELSE t END), '')"
        return f"CASE WHEN regexp_matches({x}, '[{_class(alike)}]') THEN (SELECT {fixed} FROM (SELECT {parts} AS parts)) ELSE {x} END"

    # one row per suspicious field; the others need no work
    picked = " UNION ALL ".join(f"SELECT n, {i} AS f, f{i} AS x FROM batch WHERE regexp_matches(f{i}, '[^{_usual()}]')" for i in range(len(fields)))
    return f"SELECT n, f, x AS old, nfc_normalize({words('y')}) AS form FROM (SELECT n, f, x, {form('x')} AS y FROM ({picked}))"


def consistent_text(df: DataFrame, key: str, fields: list[str], texts: bool = True) -> DataFrame:
    """(key, field_name, form, affected) for every non-null field of `df`.

    `form` is the consistent text and `affected` whether it differs from the
    stored one; with texts=False only the affected (key, field_name) are given
    and no text is sent back. Null fields give no row, empty ones are
    unchanged, repeated rows stay repeated. Idempotent: a form's form is itself.
    """
    kind = df.schema[key].dataType.simpleString()
    sql = consistent_sql(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import numpy as np

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                t = pa.table({"n": pa.array(np.arange(b.num_rows, dtype=np.int32)), **{f"f{i}": b.column(i + 1) for i in range(len(fields))}})
                con.register("batch", t)
                got = con.sql(sql).to_arrow_table().combine_chunks()
                con.unregister("batch")
                n, f, old, new = (got.column(i).to_pylist() for i in range(4))
                if not texts:
                    hit = [i for i in range(len(n)) if old[i] != new[i]]
                    keys = b.column(0).take(pa.array([n[i] for i in hit], pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([fields[f[i]] for i in hit], pa.string())], ["k_", "field_name"])
                    continue
                forms = [c.to_pylist() for c in b.columns[1:]]
                hit = [[False] * b.num_rows for _ in fields]
                for i in range(len(n)):
                    if old[i] != new[i]:
                        forms[f[i]][n[i]], hit[f[i]][n[i]] = new[i], True
                for j, name in enumerate(fields):
                    have = [i for i, x in enumerate(forms[j]) if x is not None]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(have, pa.int32())), pa.array([name] * len(have), pa.string()), pa.array([forms[j][i] for i in have], pa.string()), pa.array([hit[j][i] for i in have], pa.bool_())], ["k_", "field_name", "form", "affected"])

    schema = f"k_ {kind}, field_name string" + (", form string, affected boolean" if texts else "")
    return df.select(F.col(key), *(F.col(f).cast("string") for f in fields)).mapInArrow(run, schema).withColumnRenamed("k_", key)
