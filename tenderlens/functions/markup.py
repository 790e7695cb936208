"""Character references and tagged text by built-in expressions only: no row leaves the JVM.

A tagged text is split at its tags' first characters; what follows an element's
start tag, up to the next tag, is the element's text.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: References that the HTML standard also knows without a final semicolon, longest first.
UNTERMINATED = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
#: Numbers 128 to 159 stand for the characters of windows-1252, where it has one.
WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0))
#: Looked for most, so they come first in the table.
USUAL = "amp; lt; gt; quot; apos; nbsp; aacute; eacute; iacute; oacute; uacute; ntilde;".split()
#: All references in one constant text, found by searching it: a map of so many would be built anew for every reference.
TABLE = "\x01" + "\x01".join(f"{n}\x02{html5[n]}" for n in dict.fromkeys([*USUAL, *html5])) + "\x01"
LONGEST = max(map(len, html5.values()))
SPACE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is one variable however often body names it; else expressions double with every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _known(name: Column) -> Column:
    """Characters of a named reference; null if there is none of that name."""
    key = F.concat(F.lit("\x01"), name, F.lit("\x02"))

    def meaning(at: Column) -> Column:
        value = F.substr(F.lit(TABLE), at + F.length(name) + 2, F.lit(LONGEST + 1))
        return F.when(at > 0, F.substring_index(value, "\x01", 1))

    return let(F.position(key, F.lit(TABLE)), meaning)


def _character(n: Column) -> Column:
    """The character of that code point as browsers read it: nothing for controls and non-characters, U+FFFD for what is no character."""
    windows = F.substr(F.lit(WINDOWS), (n - 0x7F).cast("int"), F.lit(1))
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    control = n.between(1, 8) | n.between(14, 31) | n.isin(11, 127)
    no_character = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when(n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
        .when(n.between(0x80, 0x9F), windows)
        .when(control | no_character, "")
        .otherwise(plain)
    )


def _code(number: Column) -> Column:
    """The code point that #123 or #x7b names; null if it has too many digits to be one."""
    hexadecimal = F.lower(F.substring(number, 2, 1)) == "x"
    digits = F.regexp_replace(number, r"^#[xX]?0*|;$", "")
    return let(digits, lambda d: F.when(d == "", F.lit(0)).when(F.length(d) <= 10, F.when(hexadecimal, F.conv(d, 16, 10)).otherwise(d).cast("long")))


def _decoded(part: Column, lenient: bool) -> Column:
    """What stands after an ampersand, with the reference at its start resolved; the ampersand comes back where there is none."""
    end = ";?" if lenient else ";"

    def resolved(head: str, meaning: Callable[[Column], Column]) -> Column:
        """null unless that pattern begins the part and means something."""
        return let(F.regexp_extract(part, head, 0), lambda h: F.when(h != "", F.concat(meaning(h), F.substr(part, F.length(h) + 1))))

    number = resolved(rf"^#([0-9]+|[xX][0-9a-fA-F]+){end}", lambda h: let(_code(h), _character))
    name = resolved(rf"^[^\t\n\f <&#;]{{1,32}}{end}", _known)
    begun = [resolved(f"^(?:{UNTERMINATED})", _known)] if lenient else []
    return F.coalesce(number, name, *begun, F.concat(F.lit("&"), part))


def unescape(c: Column, lenient: bool = True) -> Column:
    """All named and numeric character references undone, once, as browsers read them; not lenient: only those that end in a semicolon."""

    def undone(text: Column) -> Column:
        parts = F.transform(F.split(text, "&"), lambda x, i: F.when(i == 0, x).otherwise(_decoded(x, lenient)))
        return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)

    return let(c, undone)


def given(c: Column) -> Column:
    """c, null where it is empty."""
    return let(c, lambda x: F.when(x != "", x))


def blocks(c: Column, name: str) -> Column:
    """What each element <name> holds, in order, up to its first end tag; elements without one are left out."""
    end = f"</{name}>"
    ended = F.filter(F.split(c, f"<{name}>"), lambda x, i: (i > 0) & F.contains(x, F.lit(end)))
    return F.transform(ended, lambda x: F.substring_index(x, end, 1))


def first_block(c: Column, name: str) -> Column:
    return F.get(blocks(c, name), F.lit(0))


def elements(c: Column) -> Column:
    """Start tags as (name without prefix, text), texts trimmed and undone; end tags are left out first."""

    def element(part: Column) -> Column:
        name = F.substring_index(F.regexp_extract(part, r"^[^\s/>]*", 0), ":", -1)
        text = F.btrim(F.substr(part, F.locate(">", part) + 1), F.lit(SPACE))
        return F.struct(name.alias("name"), unescape(text).alias("text"))

    starts = F.filter(F.split(c, "<"), lambda part: ~F.startswith(part, F.lit("/")))
    return F.filter(F.transform(starts, element), lambda e: (e["name"] != "") & (e["text"] != ""))


def first_text(found: Column, name: str) -> Column:
    """Text of the first of elements() with that name that has any."""
    return F.get(F.filter(found, lambda e: e["name"] == name), F.lit(0))["text"]


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the text of a tag, references undone; null if it has none."""
    value = F.regexp_extract(F.concat(F.lit(" "), tag), rf"\s{name}\s*=\s*\"([^\"]*)\"", 1)
    return given(unescape(value))
