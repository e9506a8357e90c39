"""Scalar text functions as column expressions. A null text gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = r"([^.!?\n]+[.!?]?)(\s+|$)"
IMAGE_REF = r"!\[[^\]]*\]\(([^)]+)\)"

#: Precomposed Vietnamese small letters and their plain letters: fixed values.
ACCENTED = "áàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵđ"
PLAIN = "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5 + "d"
#: Characters that separate words of a question, and phrases that mark greetings and generic replies: fixed values.
INTENT_PUNCTUATION = "?!.,;:()[]{}*#\n\t"
GREETINGS = ("xin chao", "chao ban", "hello", "hi", "hey", "alo", "good morning", "good afternoon")
GENERIC_REPLIES = ("rat vui duoc ho tro", "moi ban dat cau hoi", "xin chao", "moi ban cung cap noi dung")


def squeeze(t: Column) -> Column:
    """Runs of Unicode white space become one space; none is left around."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def blank_to_null(t: Column) -> Column:
    return F.nullif(F.regexp_replace(t, r"(?U)^\s+|\s+$", ""), F.lit(""))


def token_count(t: Column) -> Column:
    """Fields between white space; 0 for a blank text."""
    s = squeeze(t)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def simple_sentences(t: Column) -> Column:
    """Array of runs up to an end mark that white space or the end follows. What stands before an end mark inside a word is passed
    over; a text without any such run is one sentence, a blank one has none."""
    s = squeeze(t)
    found = F.filter(F.transform(F.regexp_extract_all(s, F.lit(SENTENCE), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(s == "", F.array().cast("array<string>")).when(F.size(found) == 0, F.array(s)).otherwise(found)


def tail(sentences: Column, n: int) -> Column:
    """The last n elements, or all if there are fewer."""
    if n <= 0:
        return F.array().cast("array<string>")
    return F.when(F.size(sentences) <= n, sentences).otherwise(F.slice(sentences, -n, n))


def image_refs(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(IMAGE_REF), F.lit(1)), lambda x: F.trim(x))


def without_image_refs(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, IMAGE_REF, ""))


def is_header(t: Column) -> Column:
    """Begins with #, or holds nothing but #, - and white space; a blank text is no header."""
    s = squeeze(t)
    return s.startswith("#") | ((s != "") & s.rlike(r"^[#\- ]+$"))


def is_numeric(t: Column) -> Column:
    """At least one digit and else only white space and . , : ; % - + / ( )"""
    s = squeeze(t)
    return s.rlike(r"^[\p{Nd} .,:;%+/()\-]+$") & s.rlike(r"\p{Nd}")


def is_short(t: Column, min_chars: int, min_tokens: int) -> Column:
    return (F.char_length(squeeze(t)) < min_chars) | (token_count(t) < min_tokens)


def is_noise(t: Column, min_chars: int, min_tokens: int) -> Column:
    return is_short(t, min_chars, min_tokens) & ~t.rlike(r"\p{L}")


def attaches(t: Column, min_chars: int) -> Column:
    """A fragment that belongs to the sentence before: three tokens or fewer, or under half the least length."""
    return is_numeric(t) | (token_count(t) <= 3) | (F.char_length(squeeze(t)) < min_chars // 2)


def intent_text(t: Column) -> Column:
    return squeeze(F.translate(F.lower(t), INTENT_PUNCTUATION, " " * len(INTENT_PUNCTUATION)))


def strip_accents(t: Column) -> Column:
    """Vietnamese letters in small, precomposed form lose their marks."""
    return F.translate(t, ACCENTED, PLAIN)


def overlap_text(t: Column) -> Column:
    return strip_accents(intent_text(t))


def words_of_overlap(plain: Column) -> Column:
    """Distinct words of more than one byte of an overlap_text."""
    return F.array_distinct(F.filter(F.split(plain, " "), lambda x: F.octet_length(x) > 1))


def token_set(t: Column) -> Column:
    """Distinct words of more than one byte."""
    return words_of_overlap(overlap_text(t))


def ratio_of_words(x: Column, y: Column) -> Column:
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared words over the smaller set's size; 0 if either is empty."""
    return ratio_of_words(token_set(a), token_set(b))


def preview(t: Column, most: int = 220) -> Column:
    """The trimmed text, cut to `most` characters and '...' where longer. Characters, not bytes, so none is ever torn."""
    s = F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    return F.when(F.char_length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit("...")))


def shortened(t: Column, most: int) -> Column:
    """The squeezed text within `most` characters, '...' included."""
    s = squeeze(t)
    cut = F.concat(F.substring(s, 1, most - 3), F.lit("...")) if most > 3 else F.substring(s, 1, most)
    return F.when(F.char_length(s) <= most, s).otherwise(cut)


def file_name(url: Column) -> Column:
    """The last part of a URL's or path's path, 'downloaded_file' where there is none."""
    t = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(t, r"[?#].*$", ""), r"^(?i)(https?|file)://[^/]*", "")
    whole = F.when(t.rlike(r"^(?i)(https?|file)://"), bare).otherwise(t)
    return F.coalesce(blank_to_null(F.regexp_extract(whole, r"([^/]*)$", 1)), F.lit("downloaded_file"))


def object_key(folder: Column, url: Column) -> Column:
    """<last part of the folder>/<file name of the URL>, without the folder where it has no name."""
    part = F.regexp_extract(F.regexp_replace(folder, r"/+$", ""), r"([^/]*)$", 1)
    name = F.coalesce(blank_to_null(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^(?:[A-Za-z]+://[^/]*)?.*?([^/]*)/*$", 1)), F.lit("uploaded-file"))
    prefix = blank_to_null(part)
    return F.when(prefix.isNull() | (prefix == "."), name).otherwise(F.concat(prefix, F.lit("/"), name))


def is_safe_session_id(s: Column) -> Column:
    t = blank_to_null(s)
    return F.coalesce(t.isNotNull() & ~t.contains("/") & ~t.contains("\\") & ~t.isin(".", ".."), F.lit(False))


def rfc3339(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(s: Column) -> Column:
    """The instant, or null where the text has another form."""
    shaped = s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(shaped, F.try_to_timestamp(s))


def progress_bar(done: Column, total: Column, width: int = 24) -> Column:
    inside = F.greatest(F.lit(0), F.least(done, total)).cast("double")
    ratio = F.when(total > 0, inside / total).otherwise(F.lit(0.0))
    filled = F.floor(ratio * width + 0.5).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled), F.lit("] "), F.format_string("%.1f%%", ratio * 100))


def backoff_ms(base: Column, attempt: Column, most: int = 5000) -> Column:
    """base * 2^(attempt - 1), at most `most`."""
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt - 1))
