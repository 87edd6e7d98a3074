"""Document numbers, titles and references read from payloads that name them in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.extract import date_parts, distinct_folded
from granary.functions.text import col, dedup_key, folded, let, squeeze, strip_edges

#: What marks a consolidated text, and what its title names besides its subject.
CONSOLIDATED_ID = r"(?iuU)\b(\d+\s*/\s*)?VBHN-[A-ZĐ]+\b"
CONSOLIDATED_TITLE = r"(?iuU)^văn bản hợp nhất\b"
CODE = r"(?iuU)\b\d+\s*/\s*[A-ZĐ][A-ZĐ0-9/-]*\b"
DATE = r"(?iuU)\b(?:ngày\s+)?\d{1,2}[/-]\d{1,2}[/-](?:19|20)\d{2}\b|\bngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+(?:19|20)\d{2}\b"
YEAR = r"(?iuU)\bnăm\s+(?:19|20)\d{2}\b"
ISSUED_BY = r"(?iuU)\bdo\s+.+?\s+ban hành\b"
OF_BODY = r"(?iuU)\bcủa\s+(?:văn phòng quốc hội|quốc hội|chính phủ)\b"
#: An article's number as payloads write it, and the first words of notes that are no titles.
ARTICLE_NO = r"(?iuU)\bĐiều\s+\d+[A-Za-z]?"
NO_TITLES = ("căn cứ", "theo ")
#: Where related content of another article begins, and a closing note on it.
RELATED_ARTICLE = r"(?iuU)\s+Điều\s+\d+(?:\.\d+)*\.[A-ZĐ]{1,8}\.\d+(?:\.\d+)*\.\s+"
RELATED_NOTE = r"(?iuU)\s*\(?Điều này có nội dung liên quan\b.*$"
LEAST_TITLE = 12


def text_list(c: Column) -> Column:
    """Trimmed non-empty texts of an array; null counts as an empty one."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def one_list(*cols: Column | str) -> Column:
    """The trimmed non-empty texts of several columns, in their order."""
    return text_list(F.array(*(col(c).cast("string") for c in cols)))


def folded_number(c: Column | str) -> Column:
    """A document number in the spelling with Đ."""
    return F.regexp_replace(F.regexp_replace(squeeze(c), r"(?iuU)ND-CP\b", "NĐ-CP"), r"(?iu)QD-", "QĐ-")


def numbers(values: Column) -> Column:
    """Distinct document numbers of a list in their folded spelling and order, letter case aside."""
    return distinct_folded(F.filter(F.transform(text_list(values), folded_number), lambda x: x != ""))


def number_hit(text: Column | str, wanted: list[str]) -> Column:
    """Whether a text holds one of the numbers, case and spelling aside."""
    up = F.upper(folded_number(F.upper(col(text))))
    return F.exists(F.array(*(F.upper(folded_number(F.lit(w))) for w in wanted)), lambda w: F.contains(up, w)) if wanted else F.lit(False)


def is_consolidated(values: Column) -> Column:
    return F.exists(text_list(values), lambda x: x.rlike(CONSOLIDATED_ID) | x.rlike(CONSOLIDATED_TITLE))


def subject_title(title: Column | str) -> Column:
    """What a consolidated text is about: its title without kind, codes, dates, years and issuing bodies."""
    x = strip_edges(F.regexp_replace(squeeze(title), CONSOLIDATED_TITLE, ""))
    for p in (CODE, DATE, YEAR):
        x = F.regexp_replace(x, p, "")
    x = F.regexp_replace(x, r"(?isuU)^(.*?)\bhợp nhất\b", "$1")  # the first one only
    return dedup_key(F.regexp_replace(F.regexp_replace(x, ISSUED_BY, ""), OF_BODY, ""))


def issue_date(dates: Column, title: Column | str) -> Column:
    """The first filled date text, else the date or year in the title; folded."""
    first = F.get(F.filter(F.transform(text_list(dates), dedup_key), lambda x: x != ""), F.lit(0))
    in_title = F.coalesce(F.nullif(F.regexp_extract(col(title), DATE, 0), F.lit("")), F.regexp_extract(col(title), YEAR, 0))
    return F.coalesce(first, dedup_key(in_title))


def issue_key(dates: Column, title: Column | str) -> Column:
    """struct(y, m, d) for ordering: the first date that can be read, else that of the title, else its year."""
    none = F.struct(F.lit(0).alias("y"), F.lit(0).alias("m"), F.lit(0).alias("d"))
    read = F.filter(F.transform(F.concat(text_list(dates), F.array(squeeze(title))), date_parts), lambda p: p["y"] > 0)
    year = F.regexp_extract(col(title), r"(?iuU)\bnăm\s+((?:19|20)\d{2})\b", 1)
    return F.coalesce(F.get(read, F.lit(0)), F.when(year != "", F.struct(year.cast("int").alias("y"), F.lit(0).alias("m"), F.lit(0).alias("d"))), none)


def document_key(number: Column | str, title: Column | str, dates: Column) -> Column:
    """What makes two hits one document: the subject of consolidated texts, else title and date, title and number, or title."""
    t, n, d = dedup_key(title), dedup_key(number), issue_date(dates, title)
    subject = F.when(is_consolidated(F.array(col(number), col(title))), subject_title(title)).otherwise(F.lit(""))
    key = lambda kind, *parts: F.concat_ws("|", F.lit(kind), *parts)
    return F.when(subject != "", key("subject", subject)).when((t != "") & (d != ""), key("date", t, d)).when((t != "") & (n != ""), key("number", t, n)).when(t != "", key("title", t)).otherwise(F.lit(""))


def header(text: Column | str) -> Column:
    """What comes before the first `:` at a line's end."""
    return F.trim(F.substring_index(F.coalesce(col(text), F.lit("")), ":\n", 1))


def header_title(head: Column | str, article: Column | str) -> Column:
    """The title in a header: what comes before its article, if it has one."""
    before = F.regexp_extract(col(head), r"(?isuU)^(.*?)\s+Điều\s+\d+[A-Za-z]?\b", 1)
    return strip_edges(F.when((col(article) != "") & (before != ""), before).otherwise(col(head)), " -:;,.")


def first_number_in(head: Column | str, known: Column) -> Column:
    """The first known number that stands in the header, else the first known."""
    return F.coalesce(F.get(F.filter(known, lambda n: F.contains(col(head), n)), F.lit(0)), F.get(known, F.lit(0)), F.lit(""))


def first_article(values: Column) -> Column:
    """`Điều n` of the first text that names an article."""
    found = F.filter(F.transform(text_list(values), lambda x: F.regexp_extract(x, ARTICLE_NO, 0)), lambda x: x != "")
    return F.coalesce(F.regexp_replace(F.get(found, F.lit(0)), "^điều", "Điều"), F.lit(""))


def reasonable_title(values: Column) -> Column:
    """The first text long enough for a title that is no article's number."""
    t = F.transform(text_list(values), lambda x: F.trim(x, F.lit("() ")))
    return F.coalesce(F.get(F.filter(t, lambda x: (F.length(x) > LEAST_TITLE) & (F.regexp_replace(x, ARTICLE_NO, "") != "")), F.lit(0)), F.lit(""))


def bad_title(c: Column | str) -> Column:
    """Blank, only strokes, or the beginning of a legal basis."""
    x = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return (F.trim(x, F.lit("-_ ")) == "") | F.startswith(x, F.lit(NO_TITLES[0])) | F.startswith(x, F.lit(NO_TITLES[1]))


def title_of_file(name: Column | str, number: Column | str) -> Column:
    """The title in a file's name: what follows the number, or the second underscore."""
    stem = F.regexp_replace(F.coalesce(col(name), F.lit("")), r"^.*/|(?<=.)\.[^./]*$", "")
    code = F.replace(F.coalesce(col(number), F.lit("")), F.lit("/"), F.lit("_"))

    def read(s: Column) -> Column:
        at = F.when(code != "", F.instr(s, code)).otherwise(0)
        rest = F.when(at > 0, F.ltrim(F.substr(s, at + F.length(code)), F.lit("_"))).otherwise(F.lit(""))
        third = F.regexp_extract(s, r"(?s)^[^_]*_[^_]*_(.*)$", 1)
        return F.trim(F.replace(F.when(rest != "", rest).when(s.rlike(r"(?s)^[^_]*_[^_]*_"), third).otherwise(s), F.lit("_"), F.lit(" ")))

    return let(stem, read)


def title_in_text(text: Column | str, number: Column | str) -> Column:
    """The title in a text: the rest of the line after the number within its first 500 characters, else its first line."""
    head = F.substring(F.coalesce(col(text), F.lit("")), 1, 500)
    n = F.coalesce(col(number), F.lit(""))
    at = F.when(n != "", F.instr(F.lower(head), F.lower(n))).otherwise(0)
    line = F.trim(F.split_part(head, F.lit("\n"), F.lit(1)))

    def after(rest: Column) -> Column:
        found = F.trim(F.regexp_extract(rest, r"^\s+(.+?)(?:\n|$)", 1), F.lit(" -"))
        return F.when((at > 0) & (found != ""), found).otherwise(line)

    return let(F.substr(head, at + F.length(n)), after)


def repaired_title(title: Column | str, file_name: Column | str, text: Column | str, number: Column | str) -> Column:
    """The stored title unless it is bad, else the file's, else the text's."""
    t, f = F.trim(F.coalesce(col(title), F.lit(""))), title_of_file(file_name, number)
    return F.when(~bad_title(t), t).when(~bad_title(f), f).otherwise(title_in_text(text, number))


def article_label(article: Column | str, text: Column | str) -> Column:
    """`Điều n` of a bare or full article number, else the first that the text's beginning names; null without one."""
    a = F.trim(F.coalesce(col(article), F.lit("")))
    found = F.regexp_extract(F.substring(col(text), 1, 800), r"(?iu)Điều\s+(\d+[a-zA-Z]?)", 1)
    full = F.when(F.startswith(F.lower(a), F.lit("điều")), a).otherwise(F.concat(F.lit("Điều "), a))
    return F.when(a != "", full).when(found != "", F.concat(F.lit("Điều "), found))


def bare_article(c: Column | str) -> Column:
    """An article's number without the word before it."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), r"(?iu)^điều ", ""))


def chunk_key(document: Column | str, chunk: Column | str, point: Column | str, fallback: Column) -> Column:
    """`document:chunk` if either is there, else the point, else the fallback."""
    d, c, p = (F.coalesce(col(x).cast("string"), F.lit("")) for x in (document, chunk, point))
    return F.when((d != "") | (c != ""), F.concat(d, F.lit(":"), c)).when(p != "", p).otherwise(fallback)


def repeats_number(text: Column | str, number: Column | str) -> Column:
    """Whether a text begins with its document's number twice."""
    w, n = F.split(folded(text), " "), folded(number)
    return (n != "") & F.coalesce((F.get(w, F.lit(0)) == n) & (F.get(w, F.lit(1)) == n), F.lit(False))


def shortened(c: Column | str, most: int) -> Column:
    """At most `most` characters, the last three dots if something is cut."""
    x = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, max(0, most - 3))), F.lit("...")))


def indented(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), r"(?m)^", "  ")


def without_related(c: Column | str) -> Column:
    """A note without the articles it only relates to."""
    x = squeeze(c)
    cut = let(F.regexp_instr(x, F.lit(RELATED_ARTICLE)), lambda i: F.when(i > 0, F.substr(x, F.lit(1), i - 1)).otherwise(x))
    return F.trim(F.regexp_replace(cut, RELATED_NOTE, ""))


def article_title(c: Column | str) -> Column:
    """The name of an article, without `Điều n`."""
    return F.trim(F.ltrim(F.regexp_extract(squeeze(c), r"(?iu)^Điều\s+\S+\s*(.*)$", 1), F.lit(". ")))


def names_more(title: Column | str, number: Column | str) -> Column:
    """Whether something follows the number in a title."""
    t, n = squeeze(title), F.upper(squeeze(number))
    at = F.instr(F.upper(t), n)
    return (n != "") & (at > 0) & (strip_edges(F.substr(t, at + F.length(n))) != "")


def better_title(own: Column | str, mapped: Column | str, number: Column | str) -> Column:
    """The mapped title if it names the document and the own one doesn't, or is shorter."""
    a, b = squeeze(own), squeeze(mapped)
    take = names_more(b, number) & (~names_more(a, number) | (F.length(b) > F.length(a)))
    return F.when(b == "", a).when((a == "") | take, b).otherwise(a)


def source_links(c: Column | str) -> Column:
    """array<struct<text, href>> of a JSON array; invalid JSON and links without text and address are left out."""
    x = F.from_json(col(c), "array<struct<text:string,href:string>>")
    clean = F.transform(F.coalesce(x, F.array().cast("array<struct<text:string,href:string>>")), lambda l: F.struct(squeeze(l["text"]).alias("text"), squeeze(l["href"]).alias("href")))
    return F.filter(clean, lambda l: (l["text"] != "") | (l["href"] != ""))


def article_basis(anchor: Column | str, topic: Column | str, subject: Column | str, topic_no: Column | str, subject_no: Column | str, title: Column | str, occurrence: Column | int = 0) -> Column:
    """What an article's id is a hash of; repeats of it count up."""
    basis = F.concat_ws("|", *(squeeze(col(c).cast("string")) for c in (anchor, topic, subject, topic_no, subject_no, title)))
    n = F.lit(occurrence) if isinstance(occurrence, int) else occurrence
    return F.when(n > 0, F.concat(basis, F.lit("|duplicate:"), n.cast("string"))).otherwise(basis)
