"""SQL of the text functions, for DuckDB."""

from corpusloom.functions.text import ACCENTED, GENERIC_REPLIES, GREETINGS, INTENT_PUNCTUATION, PLAIN

WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def blank_to_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def tokens(x: str) -> str:
    return f"(CASE WHEN {squeeze(x)} = '' THEN 0 ELSE len(string_split({squeeze(x)}, ' ')) END)"


def sentences(x: str) -> str:
    found = f"list_filter(list_transform(regexp_extract_all({squeeze(x)}, '([^.!?\\n]+[.!?]?)(\\s+|$)', 1), lambda s: trim(s)), lambda s: s <> '')"
    return f"(CASE WHEN {squeeze(x)} = '' THEN []::VARCHAR[] WHEN len({found}) = 0 THEN [{squeeze(x)}] ELSE {found} END)"


def header(x: str) -> str:
    s = squeeze(x)
    return f"(starts_with({s}, '#') OR ({s} <> '' AND regexp_matches({s}, '^[#\\- ]+$')))"


def numeric(x: str) -> str:
    s = squeeze(x)
    return f"(regexp_matches({s}, '^[\\p{{Nd}} .,:;%+/()\\-]+$') AND regexp_matches({s}, '\\p{{Nd}}'))"


def short(x: str, chars: int, toks: int) -> str:
    return f"(length({squeeze(x)}) < {chars} OR {tokens(x)} < {toks})"


def noise(x: str, chars: int, toks: int) -> str:
    return f"({short(x, chars, toks)} AND NOT regexp_matches({x}, '\\p{{L}}'))"


def intent(x: str) -> str:
    marks = INTENT_PUNCTUATION.replace("\n", "").replace("\t", "")
    return squeeze(f"translate(lower({x}), '{marks}' || chr(10) || chr(9), '{' ' * len(INTENT_PUNCTUATION)}')")


def overlap(x: str) -> str:
    return f"translate({intent(x)}, '{ACCENTED}', '{PLAIN}')"


def token_set(x: str) -> str:
    return f"list_distinct(list_filter(string_split({overlap(x)}, ' '), lambda t: strlen(t) > 1))"


def contains_any(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def greets(x: str) -> str:
    return contains_any(x, GREETINGS)


def generic(x: str) -> str:
    return contains_any(x, GENERIC_REPLIES)
