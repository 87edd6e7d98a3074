"""Values taken out of text, dates, ids and hashes as Column functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import TYPE_ALTERNATION, col, let, squeeze, strip_edges

#: What a document number looks like.
LAW_ID = r"(?iu)(?<![\p{L}\p{N}_])(\d{1,4}/(?:\d{4}/)?(?:QH\d+|NĐ-CP|ND-CP|TT-[A-ZĐ]+|QĐ-[A-ZĐ]+|QD-[A-ZĐ]+|VBHN-[A-ZĐ]+|NQ-[A-ZĐ]+|CP|TTLT-[A-ZĐ-]+|PL-UBTVQH\d+|UBTVQH\d+))(?![\p{L}\p{N}_])"
#: A document number of the wider form number/year/sign.
ANY_NUMBER = r"(\d{1,4}/\d{4}/[A-ZĐ]{1,4}-[A-ZĐ]+\d*)"
#: Fixed value: what an article number looks like.
ARTICLE = r"(?iu)Điều\s+([0-9]+(?:\.[0-9A-Za-zĐđ]+)*)"


def all_matches(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(pattern), F.lit(group))


def law_ids(c: Column | str, pattern: str = LAW_ID) -> Column:
    """Distinct document numbers in capitals, sorted."""
    return F.array_sort(F.array_distinct(F.transform(all_matches(c, pattern), F.upper)))


def article_numbers(c: Column | str, ordered: bool = False) -> Column:
    """Distinct `Điều n`; sorted as text, or in the order of first mention."""
    found = F.array_distinct(F.transform(all_matches(c, ARTICLE), lambda x: F.concat(F.lit("Điều "), x)))
    return found if ordered else F.array_sort(found)


def article_number(c: Column | str) -> Column:
    """The first `Điều n`, or empty."""
    n = F.regexp_extract(F.coalesce(col(c), F.lit("")), ARTICLE, 1)
    return F.when(n == "", n).otherwise(F.concat(F.lit("Điều "), n))


def distinct_folded(parts: Column) -> Column:
    """Distinct texts, letter case aside; the first spelling and the order stay."""
    keys = F.transform(parts, F.lower)
    return F.filter(parts, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def title_candidates(c: Column | str, links: Column, ids: Column, before: int = 120, after: int = 220) -> Column:
    """Titles of links, then the surroundings of each document number."""
    t = squeeze(c)

    def around(i: Column) -> Column:
        at = F.instr(F.upper(t), i)
        start = F.greatest(at - before, F.lit(1))
        return strip_edges(F.substr(t, start, at + F.length(i) + after - start), " .;,:-")

    return distinct_folded(F.filter(F.transform(F.concat(F.coalesce(links, F.array().cast("array<string>")), F.transform(ids, around)), squeeze), lambda x: x != ""))


def citation_confidence(c: Column | str, ids: Column, titles: Column) -> Column:
    return F.when((F.size(ids) > 0) & (F.size(titles) > 0), "high").when(squeeze(c) != "", "medium").otherwise("low")


def source_note(c: Column | str) -> Column:
    """struct(law_type, law_code, doc_title, article_no) of a note that names its source."""
    word = rf"(?<![\p{{L}}\p{{N}}_])({TYPE_ALTERNATION})(?![\p{{L}}\p{{N}}_])"
    #: What ends a title.
    stop = r"(?iu),\s*(có hiệu lực|hết hiệu lực|được sửa đổi|được bổ sung)|\s+ngày\s+\d{1,2}/\d{1,2}/\d{4}"

    def titled(t: Column, code: Column) -> Column:
        at = F.instr(t, code)
        sides = F.struct(F.substr(t, F.lit(1), at - 1).alias("head"), F.substr(t, at + F.length(code)).alias("tail"))

        def with_sides(s: Column) -> Column:
            # the last type before the number, and what stands between them
            last = F.struct(F.regexp_extract(s["head"], rf"(?isu)^.*{word}(.*)$", 1).alias("kind"), F.regexp_extract(s["head"], rf"(?isu)^.*{word}(.*)$", 2).alias("between"))
            tail = let(F.regexp_instr(s["tail"], F.lit(stop)), lambda i: F.when(i > 0, F.substr(s["tail"], F.lit(1), i - 1)).otherwise(s["tail"]))
            return let(last, lambda k: F.struct(squeeze(k["kind"]).alias("kind"), F.when(k["kind"] != "", squeeze(strip_edges(F.concat(k["kind"], k["between"], code, tail)))).otherwise(F.lit("")).alias("title")))

        return let(sides, with_sides)

    def with_text(t: Column) -> Column:
        code = F.regexp_extract(t, LAW_ID, 1)
        none = F.struct(F.lit("").alias("kind"), F.lit("").alias("title"))
        rest = squeeze(strip_edges(F.regexp_replace(t, r"(?iu)^(.*?)" + ARTICLE.removeprefix("(?iu)"), "$1")))
        found = let(code, lambda x: F.struct(x.alias("code"), F.when(x != "", titled(t, x)).otherwise(none).alias("t")))
        return let(found, lambda f: F.struct(f["t"]["kind"].alias("law_type"), F.upper(f["code"]).alias("law_code"), F.when(f["t"]["title"] != "", f["t"]["title"]).otherwise(rest).alias("doc_title"), article_number(t).alias("article_no")))

    return let(F.regexp_replace(F.trim(squeeze(c), F.lit("() ")), r"\s*/\s*", "/"), with_text)


def last_year(c: Column | str) -> Column:
    """The last group of four digits, if from 1800 to 2100."""
    y = F.try_element_at(all_matches(c, r"(\d{4})"), F.lit(-1)).cast("int")
    return F.when(y.between(1800, 2100), y)


def date_parts(c: Column | str) -> Column:
    """struct(y, m, d) of the first d/m/y, d-m-y or `ngày d tháng m năm y`; zeros if there is none; days aren't checked."""
    t = squeeze(c)
    a = r"(?iu)(?<![\p{L}\p{N}_])(\d{1,2})[/-](\d{1,2})[/-]((?:19|20)\d{2})(?![\p{L}\p{N}_])"
    b = r"(?iu)(?<![\p{L}\p{N}_])ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+((?:19|20)\d{2})(?![\p{L}\p{N}_])"
    part = lambda i: F.coalesce(F.when(t.rlike(a), F.regexp_extract(t, a, i)).when(t.rlike(b), F.regexp_extract(t, b, i)).cast("int"), F.lit(0))
    return F.struct(part(3).alias("y"), part(2).alias("m"), part(1).alias("d"))


def short_hash(c: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.encode(col(c), "UTF-8")), 1, 20))


def uuid5(namespace: uuid.UUID, c: Column | str) -> Column:
    """Version 5 UUID of a name in a namespace, without leaving the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(col(c), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_key(document_id: Column | str, index: Column | str, prefix: str = "doc") -> Column:
    return F.format_string(f"{prefix}:%d:chunk:%05d", col(document_id), col(index))


def doc_ref(number: Column | str, title: Column | str) -> Column:
    """`number|title`; empty unless both are there."""
    n, t = squeeze(number), squeeze(title)
    return F.when((n == "") | (t == ""), F.lit("")).otherwise(F.concat(n, F.lit("|"), t))


def article_ref(number: Column | str, title: Column | str, article: Column | str) -> Column:
    """`number|title|article`; empty unless all are there."""
    r, a = doc_ref(number, title), squeeze(article)
    return F.when((r == "") | (a == ""), F.lit("")).otherwise(F.concat(r, F.lit("|"), a))

