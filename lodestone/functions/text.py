"""Scalar and table functions over URLs, text and Markdown, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import col

FENCE = "```"

# File extensions and their languages.
LANGUAGES = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
}


def strip(x: Column | str) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def source_id(url: Column | str) -> Column:
    """Authority (user and port included) of a URL, else its path."""
    u = col(url)
    host = F.try_parse_url(u, F.lit("AUTHORITY"))
    return F.coalesce(F.when(host != "", host), F.try_parse_url(u, F.lit("PATH")))


def normalize_url(url: Column | str) -> Column:
    return F.regexp_replace(col(url), "(?s)#.*$", "")


def is_sitemap(url: Column | str) -> Column:
    u = col(url)
    return u.endswith("sitemap.xml") | F.coalesce(F.try_parse_url(u, F.lit("PATH")).contains("sitemap"), F.lit(False))


def is_txt(url: Column | str) -> Column:
    return col(url).endswith(".txt")


def crawl_route(url: Column | str) -> Column:
    """How a URL is ingested; text files are tested before sitemaps."""
    return F.when(is_txt(url), "text_file").when(is_sitemap(url), "sitemap").otherwise("webpage")


def section_headers(chunk: Column | str) -> Column:
    """Markdown headers of a chunk, as "## Title" joined by "; "."""
    c = col(chunk)
    marks = F.regexp_extract_all(c, F.lit(r"(?m)^(#+)\s+(.+)$"), F.lit(1))
    titles = F.regexp_extract_all(c, F.lit(r"(?m)^(#+)\s+(.+)$"), F.lit(2))
    return F.concat_ws("; ", F.zip_with(marks, titles, lambda m, t: F.concat_ws(" ", m, t)))


def word_count(x: Column | str) -> Column:
    return F.size(F.regexp_extract_all(col(x), F.lit(r"(?U)\S+"), F.lit(0))).cast("long")


def section_info(chunk: Column | str) -> Column:
    c = col(chunk)
    return F.struct(section_headers(c).alias("headers"), F.length(c).cast("long").alias("char_count"), word_count(c).alias("word_count"))


def code_blocks(markdown: Column | str, min_length: int = 1000, compat: bool = False) -> Column:
    """Fenced blocks: array of (code, language, context_before, context_after).

    Fences pair in order, an unpaired last one is ignored. With ``compat``, a fence at
    the very start is skipped, so that later fences pair inside out.
    """
    md = col(markdown)
    parts = F.split(md, FENCE, -1)
    n = F.size(parts)
    shift = F.when(strip(md).startswith(FENCE), 1).otherwise(0) if compat else F.lit(0)
    # Where each part begins is summed once, and goes with the part: what a lambda doesn't get, it would make again for each block.
    begins = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + 3)))
    zipped = F.arrays_zip(parts.alias("body"), F.slice(begins, 1, n).alias("at"))
    inner = F.slice(F.transform(zipped, lambda p, i: F.struct(p["body"].alias("body"), p["at"].alias("at"), i.alias("i"))), 1, F.greatest(n - 1, F.lit(0)))
    odd = F.filter(inner, lambda p: (F.pmod(p["i"] + shift, F.lit(2)) == 1) & (p["i"] > shift))

    def block(p: Column) -> Column:
        body = p["body"]
        first = F.substring_index(body, "\n", 1)
        named = (F.locate("\n", body) > 0) & (strip(first) != "") & ~F.coalesce(strip(first).contains(" "), F.lit(False)) & (F.length(strip(first)) < 20)
        code = F.when(named, strip(F.substring(body, F.length(first) + 2, 1 << 30))).otherwise(strip(body))
        lo, hi = p["at"] - 3, p["at"] + F.length(body) + 3
        return F.struct(
            code.alias("code"),
            F.when(named, strip(first)).otherwise("").alias("language"),
            strip(F.substring(md, F.greatest(lo - 1000, F.lit(0)) + 1, F.least(lo, F.lit(1000)))).alias("context_before"),
            strip(F.substring(md, hi + 1, 1000)).alias("context_after"),
        )

    return F.filter(F.transform(odd, block), lambda b: F.length(b["code"]) >= min_length)


def full_context(before: Column, code: Column, after: Column) -> Column:
    return F.concat(before, F.lit("\n\n"), code, F.lit("\n\n"), after)


def contextual_text(context: Column | str, chunk: Column | str) -> Column:
    return F.concat_ws("\n---\n", col(context), col(chunk))


def default_source_summary(source: Column | str) -> Column:
    return F.concat(F.lit("Content from "), col(source))


def truncated_summary(summary: Column | str, limit: int = 500) -> Column:
    s = col(summary)
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)


def code_query(q: Column | str) -> Column:
    q = col(q)
    return F.concat(F.lit("Code example for "), q, F.lit("\n\nSummary: Example code showing "), q)


def language_of(path: Column | str) -> Column:
    p = col(path)
    out = F.lit("unknown")
    for ext, name in LANGUAGES.items():
        out = F.when(p.endswith(ext), name).otherwise(out)
    return out


def repo_name(url: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(url), "/"), -1), r"\.git$", "")


def is_repo_url(url: Column | str) -> Column:
    u = F.lower(F.trim(col(url)))
    return F.coalesce((u != "") & (u.contains("github.com") | u.endswith(".git")) & (u.startswith("https://") | u.startswith("git@")), F.lit(False))


def line_number(location: Column | str) -> Column:
    """The number after "line", else after a colon, else 1."""
    x = col(location)
    named = F.regexp_extract(x, r"line\s*(\d+)", 1)
    after = F.regexp_extract(x, r":(\d+)", 1)
    return F.coalesce(F.nullif(named, F.lit("")).cast("long"), F.nullif(after, F.lit("")).cast("long"), F.lit(1).cast("long"))


def char_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared distinct lower-case characters over the longer length; 1 for two empty texts."""
    a, b = col(a), col(b)
    letters = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), ""), lambda c: c != ""))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(letters(a), letters(b))) / longest)
