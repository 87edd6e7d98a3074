"""Text normalisation as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every white space sign of Unicode, as a class that Java and RE2 read alike.
WHITE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: White space within a line.
INLINE = r"[ \t\r\f\x0B]"
#: Names of legal document types, longer before shorter.
SOURCE_TYPES = ["Bộ luật", "Luật", "Pháp lệnh", "Nghị quyết", "Nghị định", "Thông tư liên tịch", "Thông tư", "Quyết định", "Văn bản hợp nhất"]
TYPE_ALTERNATION = "|".join(SOURCE_TYPES)
EDGE = " ,.;:-"
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def squeeze(c: Column | str) -> Column:
    """All white space to single spaces, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), f"{WHITE}+", " "))


def squeeze_lines(c: Column | str) -> Column:
    """White space within lines to single spaces; line ends stay, at most one blank line in a row."""
    x = F.regexp_replace(F.replace(F.coalesce(col(c), F.lit("")), F.lit("\xa0"), F.lit(" ")), f"{INLINE}+", " ")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def folded(c: Column | str) -> Column:
    return F.lower(squeeze(c))


def strip_edges(c: Column | str, signs: str = EDGE) -> Column:
    return F.trim(col(c), F.lit(signs))


def dedup_key(c: Column | str) -> Column:
    """Case and outer punctuation set aside, for comparing titles."""
    return strip_edges(folded(c), " ,.;:-|\"'")


def labeled(label: str, c: Column | str) -> Column:
    """`label value`, or empty without a value."""
    x = squeeze(c)
    return F.when(x == "", F.lit("")).otherwise(F.concat(F.lit(label + " "), x))


def first_filled(*cols: Column | str) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.when(squeeze(c) != "", col(c)) for c in cols))


def joined_filled(sep: str, *cols: Column | str) -> Column:
    """The values that are neither null nor blank, squeezed and joined."""
    return F.concat_ws(sep, *(F.when(squeeze(c) != "", squeeze(c)) for c in cols))


def upper_first(c: Column | str) -> Column:
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.substr(col(c), F.lit(2)))


def clean_lines(c: Column | str, boilerplate: list[str] | None = None) -> Column:
    """Lines trimmed; blank ones, those of dots and those matching a pattern of `boilerplate` left out."""
    lines = F.transform(F.split(squeeze_lines(c), "\n"), lambda x: F.trim(x))
    keep = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\.{3,}$"))
    if boilerplate:
        any_of = "|".join(f"(?:{p})" for p in boilerplate)
        keep = F.filter(keep, lambda x: ~x.rlike(any_of))
    return F.array_join(keep, "\n")


def marked_ratio(c: Column | str) -> Column:
    """Letters with marks of the language as a share of all letters; 0 without letters."""
    x = F.lower(F.coalesce(col(c), F.lit("")))
    letters = F.length(F.regexp_replace(x, r"\P{L}", ""))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(x, f"[^{MARKED}]", "")) / letters)


def token_estimate(c: Column | str) -> Column:
    """Words x 1.35, cut to a whole number, at least 1; 0 for blank."""
    x = squeeze(c)
    words = F.size(F.split(x, " "))
    return F.when(x == "", F.lit(0)).otherwise(F.greatest(F.lit(1), (words * F.lit(1.35)).cast("int")))


def terms(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores, of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda t: F.length(t) > 1)


def join_sentences(parts: Column) -> Column:
    """Parts joined by a space after a closing sign, by `. ` elsewhere; blank parts left out."""
    return F.aggregate(
        F.filter(F.transform(parts, squeeze), lambda p: p != ""),
        F.lit("").cast("string"),
        lambda acc, p: F.when(acc == "", p).when(acc.rlike(r"[.:;?!]$"), F.concat(acc, F.lit(" "), p)).otherwise(F.concat(acc, F.lit(". "), p)),
    )


def document_context(number: Column | str, title: Column | str) -> Column:
    """Number and title, unless the title already holds the number."""
    n, t = squeeze(number), squeeze(title)
    inside = (n != "") & F.contains(F.lower(t), F.lower(n))
    return F.when(inside, t).otherwise(F.trim(F.concat(n, F.lit(" "), t)))


#: Where a title goes over into a place inside the document.
PLACE = r"(?iu)(^|[.;])\s*((Phần|Chương|Mục|Tiểu mục)\s+[A-ZĐ\d]+(\.\d+)*|Phụ lục|Danh mục|Mẫu số)(?![\p{L}\p{N}_])"


def title_only(title: Column | str) -> Column:
    """A title without the place that follows it (a chapter, an annex, or what follows ` | `)."""

    def cut(t: Column) -> Column:
        place, bar = F.regexp_instr(t, F.lit(PLACE)), F.instr(t, " | ")
        at = F.least(F.when(place > 0, place), F.when(bar > 0, bar))
        return let(at, lambda i: F.when(i.isNull(), t).otherwise(strip_edges(F.substr(t, F.lit(1), i - 1), " .;:-|")))

    return let(squeeze(title), cut)


def _without_type(title: Column, kind: Column) -> Column:
    starts = (kind != "") & F.startswith(F.lower(title), F.concat(F.lower(kind), F.lit(" ")))
    return F.when(starts, strip_edges(F.substr(title, F.length(kind) + 1))).otherwise(title)


_TYPED = rf"(?iu)^({TYPE_ALTERNATION})(?![\p{{L}}\p{{N}}_])(.*)$"


def _parts(x: Column) -> Column:
    """struct(kind, name): the document type at the start and what follows."""
    return F.struct(squeeze(F.regexp_extract(x, _TYPED, 1)).alias("kind"), strip_edges(F.regexp_extract(x, _TYPED, 2)).alias("name"))


def citation_title(title: Column | str, number: Column | str, style: str = "plain") -> Column:
    """The title to cite by: kind and name, with the number between them if style is `numbered`.

    A title of the form `kind số number name` is taken apart; otherwise the
    given number is looked for, and failing that the kind at the start.
    """
    numbered = style == "numbered"

    def joined(kind: Column, n: Column, name: Column) -> Column:
        return squeeze(F.concat_ws(" ", *([kind, n, name] if numbered else [kind, name])))

    form = r"(?iu)^(.+?)\s+số\s+(\S+)\s+(.+)$"

    def taken_apart(t: Column) -> Column:
        p = F.struct(*(squeeze(F.regexp_extract(t, form, i)).alias(n) for i, n in ((1, "kind"), (2, "code"), (3, "name"))))
        return let(p, lambda x: joined(x["kind"], x["code"], let(upper_first(title_only(x["name"])), lambda name: _without_type(name, x["kind"]))))

    def typed(x: Column, n: Column, otherwise: Column) -> Column:
        return let(_parts(x), lambda p: F.when((p["kind"] != "") & (p["name"] != ""), joined(p["kind"], n, upper_first(p["name"]))).otherwise(otherwise))

    def around(plain: Column, n: Column) -> Column:
        at = F.instr(plain, n)
        sides = F.struct(strip_edges(F.substr(plain, F.lit(1), at - 1)).alias("before"), title_only(strip_edges(F.substr(plain, at + F.length(n)))).alias("after"))

        def with_sides(s: Column) -> Column:
            after = _without_type(upper_first(s["after"]), s["before"])
            bare = lambda a: F.when(a == "", plain).otherwise(typed(a, n, plain if numbered else a))
            return let(after, lambda a: F.when((s["before"] != "") & (a != ""), joined(s["before"], n, a)).otherwise(bare(a)))

        return let(sides, with_sides)

    def without_number(plain: Column, n: Column) -> Column:
        if not numbered:
            return plain
        first, rest = F.split_part(plain, F.lit(" "), F.lit(1)), F.substr(plain, F.instr(plain, " ") + 1)
        words = F.when(F.contains(plain, F.lit(" ")), joined(first, n, upper_first(rest))).otherwise(plain)
        return F.when(n == "", plain).otherwise(typed(plain, n, words))

    def by_number(t: Column) -> Column:
        both = F.struct(squeeze(F.regexp_replace(t, r"(?iu)(?<![\p{L}\p{N}_])số\s+", "")).alias("plain"), squeeze(number).alias("n"))
        return let(both, lambda b: F.when((b["n"] != "") & F.contains(b["plain"], b["n"]), around(b["plain"], b["n"])).otherwise(without_number(b["plain"], b["n"])))

    return let(title_only(title), lambda t: F.when(t.rlike(form), taken_apart(t)).otherwise(by_number(t)))
