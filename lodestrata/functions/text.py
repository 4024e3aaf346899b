"""Text functions of retrieval: folding, tokens, anchors, routes. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no search meaning (Turkish and English), and capitals that name no configuration key.
STOP_WORDS = tuple(
    (
        "hangi hangisi nedir nerede nereden nasil neden ne kim kac mi mu mus ve veya ile icin gibi daha bir bu su o da de ki ise ya "
        "var yok olan oluyor yapiyor gelir gelen kullanilir kullaniyor calisir "
        "the a an and or of in on for to is are does do what which where how why"
    ).split()
)
CONFIG_STOP = ("API", "CDN", "CI", "CSR", "DFS", "HTML", "HTTP", "ISR", "JS", "JSON", "RCE", "RSC", "SHA", "SQL", "SSR", "TS", "TSX", "UI", "URL")


def _plain_letters() -> tuple[str, str]:
    """Letters that are another letter with marks, and that letter; and the dotless i. A letter's marks are no letters."""
    marked, plain = "ı", "i"
    for c in map(chr, range(0xC0, 0x250)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            marked, plain = marked + c, plain + base
    return marked, plain


_FOLD_FROM, _FOLD_TO = _plain_letters()


def fold(c: Column) -> Column:
    """Lower case without accents and other marks; dotted and dotless i are one letter."""
    return F.lower(F.regexp_replace(F.translate(c, _FOLD_FROM, _FOLD_TO), r"[\x{300}-\x{36F}]", ""))


def plain(said: str) -> str:
    """fold for a string that the driver holds."""
    return re.sub("[\u0300-\u036f]", "", said.translate(str.maketrans(_FOLD_FROM, _FOLD_TO))).lower()


def _alternatives(pattern: str) -> list[str]:
    r"""The alternatives of a pattern `\b(...|...)\b` if each surely begins and ends with a letter or digit; none for other patterns."""
    outer = re.fullmatch(r"\\b\((?:\?:)?(.*)\)\\b", pattern)
    found, depth = [""], 0
    for c in outer[1] if outer else "":
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            found.append("")
        else:
            found[-1] += c
        if depth < 0:
            return []
    sure = r"[A-Za-z0-9](?:\w\?|\w|[ -]|\\\.|\\d|\\s\+)*?(?:\\d|\w\\w\*|(?<![\\\\])\w\??|\(\?:\w+(?:\|\w+)*\))|[A-Za-z0-9]"
    return found if all(re.fullmatch(sure, a, re.ASCII) for a in found) else []


def ascii_words(pattern: str) -> str:
    r"""pattern with \b as a border of ASCII words, as \w has it; by itself it would also count letters beyond."""
    if _alternatives(pattern):  # what is found begins and ends inside a word, so one look at each end does
        return rf"(?<!\w){pattern[2:-2]}(?!\w)"
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def word_stems(pattern: str) -> list[str]:
    r"""Lower-case strings of which any text that a pattern `\b(...|...)\b` is found in, in any case of ASCII letters, holds one; none if unknown."""
    begun = [re.match(r"(?:[A-Za-z0-9-](?!\?)|\\\.| (?=\w))*", a)[0].replace("\\.", ".").strip().lower() for a in _alternatives(pattern)]
    return sorted({a for a in begun if not any(b != a and b in a for b in begun)}) if all(begun) else []


def found_in(c: Column, pattern: str, lower: Column | None = None) -> Column:
    """Whether a pattern of words is found in c, in any case: few texts hold a stem of a word, and only these are matched.

    lower: c in lower case, for callers that ask for many patterns.
    """
    exact, stems = c.rlike("(?i)" + ascii_words(pattern)), word_stems(pattern)
    low = F.lower(c) if lower is None else lower
    return reduce(Column.__or__, [F.contains(low, F.lit(s)) for s in stems]) & exact if stems else exact


def camel_split(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")


def terms(c: Column, least: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct search terms: camel case split, folded, runs of letters and digits of a least length, without stop words."""
    found = F.regexp_extract_all(fold(camel_split(c)), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop)))


def qualified_anchors(c: Column) -> tuple[Column, Column]:
    """Files that a question names by a path, and symbols that it names by file#symbol or, in camel case, by themselves."""
    file = r"(?i)(?:[\w@.()\[\]-]+/)+[\w@.()\[\]-]+\.(?:[cm]?[jt]sx?|json|html|css|scss|md)"
    symbol = r"[\w@.()\[\]/-]+\.[cm]?[jt]sx?#[A-Za-z_$][\w$]*"
    bare = ascii_words(r"\b[a-z][A-Za-z0-9_$]*[A-Z][A-Za-z0-9_$]*\b")
    all_ = lambda pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.array_distinct(all_(file)), F.array_distinct(F.concat(all_(symbol), all_(bare)))


#: A token: letters and digits of any script, after folding.
TOKEN = r"[\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    """All runs of letters and digits, folded, in order."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def route_key(c: Column) -> Column:
    """What equal routes share: without blanks around, percent-decoded (a plus stays), folded, without slashes at the end."""
    trimmed = F.trim(c)
    decoded = F.coalesce(F.try_url_decode(F.replace(trimmed, F.lit("+"), F.lit("%2B"))), trimmed)
    cut = F.regexp_replace(fold(decoded), "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


def url_path(c: Column) -> Column:
    """The path of a URL without query and fragment."""
    path = F.regexp_extract(c, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def path_to_route(c: Column) -> Column:
    """A page file's route: groups `(x)` and slots `@x` go, intercepts `(.)`, `(..)`, `(...)` resolve, `[p]` stays.

    `(.)x` stays on its level, each `(..)` drops one level before it, `(...)` starts at the root.
    """
    inner = F.regexp_replace(F.regexp_replace(c, r"^(src/)?(app|pages)/", ""), r"(^|/)(page|route|index)?\.?(tsx|ts|jsx|js)$", "")
    inner = F.regexp_replace(inner, r"\.(tsx|ts|jsx|js)$", "")
    parts = F.filter(F.split(inner, "/"), lambda p: (p != "") & ~p.startswith("@") & ~p.rlike(r"^\([^.)]+\)$"))
    bare = lambda p: F.regexp_replace(p, r"^(\(\.{1,3}\))+", "")
    ups = lambda p: F.regexp_count(p, F.lit(r"\(\.\.\)"))

    def step(acc: Column, p: Column) -> Column:
        from_root = F.array(bare(p))
        drop = F.greatest(F.size(acc) - ups(p), F.lit(0))
        return F.when(p.startswith("(...)"), from_root).otherwise(F.concat(F.slice(acc, F.lit(1), drop), F.array(bare(p))))

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def normal_remote(c: Column) -> Column:
    """One form for ssh, https and credential remotes of a repository: host/path, lower case, without .git and slashes."""
    plain = F.regexp_replace(F.lower(F.trim(c)), r"^[a-z+]+://", "")
    plain = F.regexp_replace(plain, r"^[^@/]+@", "")
    plain = F.regexp_replace(plain, r"^([^/:]+):(?!\d)", "$1/")
    return F.regexp_replace(F.regexp_replace(plain, r"[?#].*$", ""), r"(\.git)?/*$", "")


def config_anchors(c: Column) -> Column:
    """Configuration keys named in a question: capitals with digits and underscores, without common abbreviations."""
    found = F.regexp_extract_all(c, F.lit(ascii_words(r"\b[A-Z][A-Z0-9_]{2,}\b")), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, CONFIG_STOP)))


def route_anchor(c: Column) -> Column:
    """The first /path in a text that is neither part of a word or URL nor a source file; null if none."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_/:.])/[A-Za-z0-9_\[\]./-]*"), F.lit(0))
    return F.get(F.filter(found, lambda p: ~p.rlike(r"\.(ts|tsx|js|jsx|mjs|cjs)$") & ~p.startswith("//")), F.lit(0))


def question_hash(c: Column) -> Column:
    """A short stable name for a question that doesn't reveal it."""
    return F.substring(F.sha2(F.lower(F.trim(c)), 256), 1, 32)


def token_estimate(chars: Column, per_token: float = 3.5) -> Column:
    return F.ceil(chars / F.lit(per_token)).cast("long")


def hit_ratio(wanted: Column, given: Column, prefix: int = 4) -> Column:
    """Share of wanted terms that a given token equals or, from `prefix` letters on, extends or shortens."""

    def meets(t: Column) -> Column:
        near = lambda g: (F.length(t) >= prefix) & (F.length(g) >= prefix) & (g.startswith(t) | t.startswith(g))
        return F.exists(given, lambda g: (g == t) | near(g))

    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(F.filter(wanted, meets)) / F.size(wanted))


def matcher_regex(pattern: str) -> str:
    """A path matcher as a regular expression: /:x one segment, /:x? none or one, /:x+ some, /:x* any number."""
    parts = re.split(r"(/:[A-Za-z_]\w*[*+?]?)", pattern)
    end = {"*": "(?:/[^/]+)*", "+": "(?:/[^/]+)+", "?": "(?:/[^/]+)?"}
    return "^" + "".join(end.get(p[-1], "/[^/]+") if p.startswith("/:") else re.escape(p) for p in parts) + "/?$"
