"""Text expressions, all evaluated in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \w is ASCII; this class is what Unicode word characters are.
TOKEN = r"[\p{L}\p{N}_]+"

# Phrases that the answer checks and the recency rules look for.
INFERENCE_INDICATORS = ["có thể", "có lẽ", "chắc là", "dường như", "hình như", "tôi nghĩ", "tôi cho rằng", "theo tôi", "probably", "maybe", "perhaps", "i think", "i believe", "it seems", "likely", "possibly", "suy ra", "từ đó", "do đó có thể thấy"]
NO_INFO_PHRASES = ["không có thông tin", "không tìm thấy", "không đề cập", "không được nêu", "không có trong", "no information", "not found", "not mentioned", "không rõ"]
TRANSITIONAL_PHRASES = ["dưới đây là", "sau đây là", "cụ thể như sau", "here is", "below are", "the following", "theo như", "based on"]
CONTENT_WORDS = ["sinh viên", "học phí", "điểm", "môn học", "quy định", "thời gian", "học kỳ", "tín chỉ", "đăng ký", "deadline", "hạn", "yêu cầu"]
UPDATE_KEYWORDS = ["mới", "cập nhật", "sửa đổi", "thay đổi", "điều chỉnh", "bổ sung", "thay thế", "hiện tại", "hiện hành", "new", "updated", "revised", "current", "latest", "effective from", "có hiệu lực từ"]
OLD_KEYWORDS = ["cũ", "trước đây", "trước kia", "đã hết hạn", "không còn", "old", "previous", "former", "outdated", "deprecated", "đã bãi bỏ", "hết hiệu lực"]
BOOST_KEYWORDS = ["mới", "cập nhật", "hiện hành", "new", "updated", "current"]
UNBOOST_KEYWORDS = ["cũ", "trước đây", "old", "previous", "deprecated"]
ENTITY_PATTERNS = ["(học phí|điểm|môn học|tín chỉ|học kỳ)", "(đăng ký|deadline|hạn|thời gian)", "(quy định|quy chế|điều|khoản)", "(sinh viên|học sinh|học viên)", r"(\d+(?:\.\d+)?%)", r"(\d{4})"]
KEY_VALUE_PATTERNS = [r"([\w\s]+)\s+(?:là|bằng|=)\s+([\d,.]+(?:\s*%)?)", r"([\w\s]+):\s*([\d,.]+(?:\s*%)?)", r"(điểm|học phí|tín chỉ|thời gian)\s+(?:tối thiểu|tối đa|cần thiết)?\s*(?:là|:)?\s*([\d,.]+)"]
DATE_PATTERNS = [r"ngày\s+(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"năm\s+(\d{4})", r"tháng\s+(\d{1,2})[/-](\d{4})", r"(\d{4})-(\d{2})-(\d{2})"]
VERSION_PATTERN = r"quy\s*định\s+(?:số\s+)?(\d+)[/-](\d{4})"
# Fixed values end.


def strip(c: Column) -> Column:
    """Without white space at either end (trim takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Split after . ! ? and white space; punctuation stays."""
    return non_blank(F.split(c, r"(?<=[.!?])\s+"))


def bare_sentences(c: Column, longer_than: int = 10) -> Column:
    """Split at . ! ? with white space; that punctuation goes, short sentences too."""
    return F.filter(F.transform(F.split(c, r"[.!?]\s+"), strip), lambda x: F.length(x) > longer_than)


def contains_any(c: Column, phrases: list[str]) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])


def count_of(c: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur (each once)."""
    low = F.lower(c)
    return reduce(lambda a, b: a + b, [low.contains(p).cast("int") for p in phrases])


def claims(answer: Column) -> Column:
    """Sentences of over 15 characters that are more than a transition."""
    return F.filter(bare_sentences(answer, 15), lambda x: ~contains_any(x, TRANSITIONAL_PHRASES))


def normalise(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def metric_tokens(c: Column) -> Column:
    return F.filter(F.split(normalise(c), " "), lambda x: x != "")


def ngrams(parts: Column, n: int) -> Column:
    """Joined n-grams of an array of strings; none if it is shorter."""
    return F.when(F.size(parts) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "\x01"))).otherwise(F.array().cast("array<string>"))


def key_terms(c: Column) -> Column:
    """Numbers, quoted strings, capitalised words of over three characters and domain words, distinct."""
    numbers = F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?%?"), F.lit(0))
    quoted = F.regexp_extract_all(c, F.lit(r'"([^"]+)"'), F.lit(1))
    capital = F.filter(words(c), lambda w: (F.length(w) > 3) & w.rlike(r"^\p{Lu}"))
    domain = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(" + "|".join(CONTENT_WORDS) + r")\b"), F.lit(1))
    return F.array_distinct(F.concat(numbers, quoted, capital, domain))


def entities(c: Column) -> Column:
    low = F.lower(c)
    found = [F.regexp_extract_all(low, F.lit(p), F.lit(1)) for p in ENTITY_PATTERNS]
    capital = F.transform(F.filter(words(c), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}")), F.lower)
    return F.array_distinct(F.concat(*found, capital))


def parse_date(c: Column) -> Column:
    """yyyy-MM-dd, dd/MM/yyyy or yyyy/MM/dd; null otherwise."""
    kinds = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"))
    return F.coalesce(*[F.when(c.rlike(p), F.try_to_date(c, f)) for p, f in kinds])


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.format_string("%s-%s-%s", y, m, d)
    return F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text), "yyyy-M-d")


def text_date(c: Column, versions: bool = False) -> Column:
    """The first date, in order of pattern, that a text states; an invalid one gives way to the next pattern.

    ``versions`` also reads a regulation's number and year as month and year.
    """
    # a pattern's groups are bound to names, so that each is looked for once a row, and only in texts that the pattern fits
    def step(p: str, y: int, m: int, d: int) -> Column:
        g = lambda i: F.regexp_extract(c, "(?i)" + p, i) if i else F.lit("1")
        read = F.transform(F.array(F.struct(g(y).alias("y"), g(m).alias("m"), g(d).alias("d"))), lambda x: _date(x["y"], x["m"], x["d"]))[0]
        return F.when(c.rlike("(?i)" + p), read)

    places = [(3, 2, 1), (3, 2, 1), (1, 0, 0), (2, 1, 0), (1, 2, 3)]  # groups of year, month and day of each pattern
    steps = [step(p, y, m, d) for p, (y, m, d) in zip(DATE_PATTERNS, places)]
    if versions:
        steps.append(step(VERSION_PATTERN, 2, 1, 0))
    return F.coalesce(*steps)


def key_values(c: Column) -> Column:
    """map of key to value that a text states ("x is 5", "x: 5%"); later statements override earlier ones."""
    pairs = F.concat(*[F.arrays_zip(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(1)), lambda x: F.lower(strip(x))).alias("k"), F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(2)), strip).alias("v")) for p in map("(?iU)".__add__, KEY_VALUE_PATTERNS)])
    pairs = F.filter(pairs, lambda x: (x["k"] != "") & (x["v"] != ""))

    def last(p: Column) -> Column:
        return F.filter(F.transform(p, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i"))), lambda x: ~F.exists(F.slice(p, x["i"] + 2, F.size(p)), lambda y: y["k"] == x["k"]))

    bound = F.transform(F.array(pairs), lambda p: F.transform(last(p), lambda x: F.struct(x["k"], x["v"])))[0]  # pairs are read once a row
    return F.map_from_entries(bound)


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def mm_ss(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60)


def hh_mm_ss(seconds: Column) -> Column:
    """HH:MM:SS.ss; null counts as 00:00:00."""
    h, m = F.floor(seconds / 3600).cast("long"), F.floor(seconds % 3600 / 60).cast("long")
    return F.coalesce(F.format_string("%02d:%02d:%05.2f", h, m, seconds % 60), F.lit("00:00:00"))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm"""
    ms = F.floor(seconds % 1 * 1000).cast("long")
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60, ms)
