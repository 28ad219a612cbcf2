"""URL and page-markup columns.

URLs are taken apart by pattern, not by a strict parser: links in the wild hold blanks and other
characters that a strict parser rejects.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

from setledger.functions.text import blank_to_null, strip

_SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def _path(url: Column) -> Column:
    """Path without the ;parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1), ";[^/]*$", "")


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"//([^/?#]*)", 1)


def file_stem(url: Column) -> Column:
    """Readable name of a URL's last path segment plus a short digest of the whole URL."""
    segment = F.substring_index(F.trim(_path(url), F.lit("/")), "/", -1)
    slug = F.trim(F.regexp_replace(segment, "[^a-zA-Z0-9_-]+", "-"), F.lit("-"))
    named = F.when(slug == "", "article").otherwise(slug)
    return F.concat_ws("_", named, F.substring(F.sha1(url), 1, 8))


def site_name(url: Column) -> Column:
    """Host with its port, lower case, without a leading www."""
    return F.nullif(F.regexp_replace(F.lower(_authority(url)), r"^www\.", ""), F.lit(""))


def video_id(url: Column) -> Column:
    """The first non-blank v of a watch link's query, or the path of a short link."""
    clean = strip(url)
    host = _authority(clean)
    value = F.nullif(F.regexp_extract(clean, r"^[^?#]*\?(?:[^#]*?&)?v=([^&#]+)", 1), F.lit(""))
    from_query = F.coalesce(F.try_url_decode(value), value)
    from_path = F.nullif(F.ltrim(_path(clean), F.lit("/")), F.lit(""))
    return F.when(host.contains("youtube.com"), from_query).when(host.contains("youtu.be"), from_path)


def _text_map(pairs: dict[str, str]) -> Column:
    """Keys to characters as UTF-32 in hex; folded to a constant by the optimizer."""
    told = (f"{key}={''.join(f'{ord(x):08X}' for x in chars)}" for key, chars in pairs.items())
    return F.str_to_map(F.lit(" ".join(told)), F.lit(" "), F.lit("="))


def _windows_characters() -> dict[str, str]:
    """What the code points 128 to 159 stand for in pages: Windows characters, where there is one."""
    return {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def unescape_html(c: Column) -> Column:
    """Named and numeric character references, each read once from left to right, as browsers read them:
    the closing semicolon of numbers and of the oldest names may be missing (longest name first)."""
    named = _text_map(html5)
    open_names = {name: chars for name, chars in html5.items() if not name.endswith(";")}
    sizes = sorted({len(name) for name in open_names}, reverse=True)
    unclosed, windows = _text_map(open_names), _text_map(_windows_characters())

    def numeric(code: Column) -> Column:
        readable = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        dropped = (code.between(1, 8) | code.isin(11, 127) | code.between(14, 31) | code.between(0xFDD0, 0xFDEF)
                   | ((code % 0x10000) >= 0xFFFE))
        return (F.when(code.isNull() | ~readable, "0000FFFD")
                .when(code.between(0x80, 0x9F), F.try_element_at(windows, code.cast("string")))
                .when(dropped, "").otherwise(F.lpad(F.hex(code), 8, "0")))

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
        digits = F.regexp_extract(name, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
        code = (F.when(F.length(digits) > 8, None).when(digits == "", F.lit(0))
                .when(name.rlike("^#[xX]"), F.conv(digits, 16, 10).try_cast("bigint"))
                .otherwise(digits.try_cast("bigint")))
        whole = F.when(name.startswith("#"), numeric(code)).otherwise(F.try_element_at(named, name))

        def replaced(found: Column, size: Column) -> Column:
            return F.concat(F.decode(F.unhex(found), "UTF-32"), F.substr(part, size + 2))

        starts = [replaced(F.when(~name.startswith("#"), F.try_element_at(unclosed, F.left(name, F.lit(n)))), F.lit(n))
                  for n in sizes]
        return F.coalesce(replaced(whole, F.length(name)), *starts, part)

    pieces = F.transform(F.split(c, "(?=&)"), one)
    return F.when(c.contains("&"), F.array_join(pieces, "")).otherwise(c)


def html_title(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    text = strip(unescape_html(inner))
    return blank_to_null(F.regexp_replace(text, r"\s*-\s*YouTube\s*$", ""))


def owner_name(html: Column) -> Column:
    return blank_to_null(unescape_html(F.regexp_extract(html, r'"ownerChannelName":"(.*?)"', 1)))


def oembed_title(payload: Column) -> Column:
    return blank_to_null(F.get_json_object(payload, "$.title"))


def oembed_author(payload: Column) -> Column:
    return blank_to_null(F.get_json_object(payload, "$.author_name"))


def video_fields(payload: Column, page: Column) -> Column:
    """Title and author of a video as a struct: both from the oEmbed answer when it has either, else from the page;
    a page without a title gives neither."""
    title, author = oembed_title(payload), oembed_author(payload)
    answered = title.isNotNull() | author.isNotNull()
    titled = F.coalesce(page.rlike(r"(?is)<title>.*?</title>"), F.lit(False))
    return F.struct(F.when(answered, title).when(titled, html_title(page)).alias("title"),
                    F.when(answered, author).when(titled, owner_name(page)).alias("author"))
