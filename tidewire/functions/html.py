"""Main text of an HTML page as column expressions.

Two readings of a page: its articles with page furniture cut out, and, for pages
without one, all lines of the body that are not mainly links. Elements that are
never closed end where a reader would end them: hidden ones at the end of the page,
paragraphs at the next block. Articles and furniture may lie in each other and in
their like: their tags are folded with a stack. An end tag closes the nearest open
element of its name and all that was opened since; one without a start tag is
ignored; furniture that nothing closes is none, an article then reaches to the end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import text

#: The public table of HTML entity names, from the standard library, by their first letter.
ENTITIES: dict[str, dict[str, str]] = {}
for _name, _char in sorted(html5.items()):
    if _name.endswith(";"):
        ENTITIES.setdefault(_name[0], {})[_name[:-1]] = _char

HIDDEN = ("script", "style", "noscript", "template")
FURNITURE = ("nav", "aside", "form", "footer")
MENUS = ("header", "menu", "select", "button")
BLOCKS = "address|article|aside|blockquote|body|center|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
INLINE = "a|abbr|b|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|u"
#: Marks around the text of a link.
LINK, END = "\x01", "\x02"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_SPANS = "array<struct<first:int,last:int>>"
_OPENED = f"struct<open:array<struct<name:string,at:int>>,hidden:{_SPANS},articles:{_SPANS}>"


def _fold_tag(state: Column, tag: Column) -> Column:
    """The stack after one tag; closed furniture and outermost articles as spans of the pieces between tags."""
    depth = F.array_position(F.reverse(state["open"]["name"]), tag["name"]).cast("int")
    pushed = F.struct(
        F.concat(state["open"], F.array(F.struct(tag["name"].alias("name"), tag["at"].alias("at")))).alias("open"),
        state["hidden"].alias("hidden"),
        state["articles"].alias("articles"),
    )

    def closed(popped: Column) -> Column:
        rest = F.slice(state["open"], 1, F.size(state["open"]) - depth)
        cover = F.get(F.filter(popped, lambda e: e["name"] != "article"), F.lit(0))["at"]
        opened = F.get(F.filter(popped, lambda e: e["name"] == "article"), F.lit(0))["at"]
        # an article in furniture goes with it, as do spans found inside
        outermost = opened.isNotNull() & ~F.exists(rest, lambda e: e["name"] == "article") & (cover.isNull() | (opened < cover))

        def span(start: Column) -> Column:
            return F.array(F.struct((start + 1).alias("first"), tag["at"].alias("last")))

        def before(spans: Column) -> Column:
            return F.when(cover.isNull(), spans).otherwise(F.filter(spans, lambda x: x["first"] <= cover))

        nothing = F.array().cast(_SPANS)
        return F.struct(
            rest.alias("open"),
            F.concat(before(state["hidden"]), F.when(cover.isNotNull(), span(cover)).otherwise(nothing)).alias("hidden"),
            F.concat(before(state["articles"]), F.when(outermost, span(opened)).otherwise(nothing)).alias("articles"),
        )

    popped = F.slice(state["open"], F.size(state["open"]) - depth + 1, depth)
    return F.when(~tag["closing"], pushed).when(depth > 0, _let(popped, closed)).otherwise(state).cast(_OPENED)


def visible_parts(html: Column, furniture: tuple[str, ...]) -> Column:
    """Struct of `page`, the source without furniture, and `article`, what of it lies in article elements."""
    pattern = rf"(?i)</?(?:{'|'.join((*furniture, 'article'))})(?:[\s/][^>]*)?>"

    def named(tag: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, "^</?([A-Za-z0-9]+)", 1))
        return F.struct(name.alias("name"), (i + 1).alias("at"), F.startswith(tag, F.lit("</")).alias("closing"))

    def parts(cut: Column) -> Column:
        def joined(spans: Column, hidden: Column) -> Column:
            def pieces(x: Column) -> Column:
                return F.flatten(F.transform(x, lambda s: F.sequence(s["first"], s["last"])))

            return F.array_join(F.transform(F.array_except(pieces(spans), pieces(hidden)), lambda i: F.get(cut["texts"], i - 1)), " ")

        def read(state: Column) -> Column:
            count = F.size(cut["texts"])
            last = F.get(F.filter(state["open"], lambda e: e["name"] == "article"), F.lit(0))["at"]
            unclosed = F.array(F.struct((last + 1).alias("first"), count.alias("last")))
            articles = F.when(last.isNull(), state["articles"]).otherwise(F.concat(state["articles"], unclosed))
            whole = F.array(F.struct(F.lit(1).alias("first"), count.alias("last")))
            return F.struct(joined(whole, state["hidden"]).alias("page"), joined(articles, state["hidden"]).alias("article"))

        start = F.struct(F.array().alias("open"), F.array().alias("hidden"), F.array().alias("articles")).cast(_OPENED)
        return _let(F.aggregate(cut["tags"], start, _fold_tag), read)

    tags = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), named)
    return F.when(html.isNotNull(), _let(F.struct(F.split(html, pattern).alias("texts"), tags.alias("tags")), parts))


def without_hidden(html: Column) -> Column:
    """Remove comments and elements that never show, up to the end of the page if they are not closed."""
    shown = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " ")
    return reduce(lambda c, n: F.regexp_replace(c, rf"(?is)<{n}\b[^>]*>.*?(?:</{n}\s*>|\z)", " "), HIDDEN, shown)


def _code_point(digits: Column, base: int) -> Column:
    point = F.conv(digits, base, 10).cast("bigint")
    valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def decode_entities(value: Column) -> Column:
    """Named and numeric entities to characters, each decoded once; unknown ones stay."""
    def table(names: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    # by first letter and then by name: a lookup walks about a hundred entries
    letters = F.create_map(*[x for letter, names in ENTITIES.items() for x in (F.lit(letter), table(names))])

    def piece(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#?[A-Za-z0-9]{1,31});", 1)
        char = (
            F.when(name.rlike("^#[0-9]{1,7}$"), _code_point(F.substr(name, F.lit(2)), 10))
            .when(name.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), _code_point(F.substr(name, F.lit(3)), 16))
            .when(name != "", F.try_element_at(F.try_element_at(letters, F.substring(name, 1, 1)), name))
        )
        rest = F.substr(part, F.length(name) + 2)
        return F.when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))

    def decoded(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece), ""))

    return _let(F.split(value, "&"), decoded)


def without_tags(html: Column) -> Column:
    """Inline tags vanish, all others separate words."""
    inline = F.regexp_replace(html, rf"(?i)</?(?:{INLINE})(?:\s[^>]*)?>", "")
    return F.regexp_replace(inline, r"</?[A-Za-z!][^>]*>", " ")


def primary_text(html: Column) -> Column:
    """Text of the article elements, else of all paragraphs; null if empty."""
    paragraph = rf"(?is)<p\b[^>]*>(.*?)(?=</p\s*>|</?(?:{BLOCKS})\b|\z)"

    def body(parts: Column) -> Column:
        paragraphs = F.array_join(F.regexp_extract_all(parts["page"], F.lit(paragraph), F.lit(1)), " ")
        return F.when(parts["article"] != "", parts["article"]).otherwise(paragraphs)

    return text.clean_extracted(decode_entities(without_tags(_let(visible_parts(without_hidden(html), FURNITURE), body))))


def fallback_text(html: Column) -> Column:
    """All body lines outside menus of which links make less than half; null if none."""
    page = visible_parts(without_hidden(html), FURNITURE + MENUS)["page"]
    body = F.regexp_replace(page, r"(?is)^.*?<body\b[^>]*>", "")
    flat = F.regexp_replace(body, r"[\r\n\x01\x02]+", " ")
    linked = F.regexp_replace(F.regexp_replace(flat, r"(?i)<a(?:\s[^>]*)?>", LINK), r"(?i)</a\s*>", END)
    inline = F.regexp_replace(linked, rf"(?i)</?(?:{INLINE})(?:\s[^>]*)?>", "")
    lines = F.split(F.regexp_replace(inline, r"</?[A-Za-z!][^>]*>", "\n"), "\n")

    def prose(line: Column) -> Column:
        whole = F.length(text.collapse_whitespace(F.regexp_replace(line, r"[\x01\x02]", "")))
        own = F.length(text.collapse_whitespace(F.regexp_replace(line, r"\x01[^\x02]*\x02?", "")))
        return (whole > 0) & (2 * own > whole)

    kept = F.transform(F.filter(lines, prose), lambda line: F.regexp_replace(line, r"[\x01\x02]", ""))
    return text.clean_extracted(decode_entities(F.array_join(kept, " ")))
