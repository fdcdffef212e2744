"""Text functions as column expressions: tokens, cleaning, safety checks and routes. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
ENTER = "进入"

# Fixed values, equal to those of the behaviour reproduced: phrases, schemes, control characters and limits.
INJECTIONS = (
    "忽略上述", "忽略上面", "忽略之前", "忽略前面", "无视上述", "无视上面", "无视之前",
    "ignore previous", "ignore above", "ignore prior", "ignore all previous", "disregard previous", "disregard above",
    "system:", "</system>", "<|system|>", "<|im_start|>", "role:", "现在你是", "现在你扮演", "现在你是一个",
    "你的新指令", "新指令如下", "override previous", "override instructions", "你被重新设定", "jailbreak",
)
UNSAFE_SCHEMES = ("javascript:", "data:", "vbscript:", "file:", "about:")
CONTROL = r"[\x00-\x1F\x7F​-‏  ‪-‮⁠﻿]"
MAX_QUERY, MAX_TEXT, MAX_REASON, MAX_ID = 200, 2000, 200, 100

_INJECTION = "(?i)" + "|".join(rf"\Q{p}\E" for p in INJECTIONS)


def strip_(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokenize(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def is_injection(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(_INJECTION)


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def sanitize_query(c: Column) -> Column:
    """A query without control characters, trimmed and cut to its limit; whether to reject it is is_injection of that."""
    return F.substring(strip_(strip_control(F.coalesce(c, F.lit("")))), 1, MAX_QUERY)


def sanitize_prompt(c: Column) -> Column:
    return F.regexp_replace(strip_control(F.coalesce(c, F.lit(""))), _INJECTION, "[filtered]")


def strip_markdown(c: Column) -> Column:
    c = F.regexp_replace(c, r"^#{1,6}\s+", "")
    c = F.regexp_replace(c, r"#{2,}\s*", " ")
    return strip_(F.regexp_replace(c, " {2,}", " "))


def sanitize_text(c: Column, limit: int = MAX_TEXT) -> Column:
    return F.substring(strip_markdown(strip_control(F.coalesce(c, F.lit("")))), 1, limit)


def strip_html(c: Column) -> Column:
    """Tags taken out (what stands between them stays), then & < > escaped."""
    c = F.regexp_replace(c, "<[^>]+>", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def valid_route(c: Column) -> Column:
    """True for relative paths, http, https and mailto; a scheme counts only before // or at the end."""
    low = F.lower(strip_(F.coalesce(c, F.lit(""))))
    unsafe = F.lit(False)
    for s in UNSAFE_SCHEMES:
        unsafe = unsafe | low.startswith(s)
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.\-]*):(?://|$)", 1)
    return F.when(low == "", False).when(unsafe, False).when(scheme != "", scheme.isin("http", "https", "mailto")).otherwise(True)


def safe_route(c: Column) -> Column:
    return F.when(valid_route(c), c).otherwise(F.lit(""))


def slug_component(path: Column) -> Column:
    """Page component named after a path's last part: /go/open-account -> OpenAccount."""
    last = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    parts = F.filter(F.split(F.when(last == "", path).otherwise(last), "[-_/]+"), lambda x: x != "")
    name = F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")
    return F.when(name == "", F.lit("ServicePage")).otherwise(name)


def private_host(host: Column) -> Column:
    """True for hosts that must not be fetched: none, local names, and IPv4 addresses of private or reserved ranges."""
    h = F.lower(F.coalesce(host, F.lit("")))
    octets = F.transform(F.split(h, r"\."), lambda x: x.try_cast("int"))
    a, b, c, d = (F.get(octets, i) for i in range(4))
    is_ip = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    bad = F.exists(octets, lambda x: x > 255) | F.exists(F.split(h, r"\."), lambda x: x.rlike("^0[0-9]"))
    inside = (
        a.isin(0, 10, 127) | (a >= 240) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | ((a == 192) & (b == 0) & (c == 0) & ~d.isin(9, 10)) | ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return (h == "") | h.isin("localhost", "localhost.localdomain") | h.endswith(".local") | h.endswith(".internal") | (is_ip & (bad | inside))


def hash_user(user: Column, salt: str) -> Column:
    return F.sha2(F.concat(user, F.lit(salt)), 256)


def cache_key(user: Column, query: Column, mode: Column) -> Column:
    return F.concat_ws(":", F.lit("es:res"), user, F.sha2(query, 256), mode)


def extract_json(c: Column) -> Column:
    """The JSON inside a model's answer: without a code fence, else the text from the first [ to the last ]."""
    t = F.regexp_replace(strip_(c), r"^```(?:json)?\s*|\s*```$", "")
    found = F.coalesce(F.when(F.try_parse_json(t).isNotNull(), t), F.nullif(F.regexp_extract(t, r"(?s)(\[.*\])", 1), F.lit("")))
    return F.when(F.try_parse_json(found).isNotNull(), found)
