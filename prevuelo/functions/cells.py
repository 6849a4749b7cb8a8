"""SQL expressions that look at one cell.

Every cell is text.  NULL is a *missing* cell; a present cell without a visible character
is an *empty* cell; everything else is *usable*.  The functions take and return SQL text:
a frame repeats them for each of its columns, and one text is parsed in one go where a
chain of Column calls would cross into the JVM for every operator.
"""

from __future__ import annotations

from collections.abc import Iterable

# The characters that count as white space.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

BOOLEAN = r"(?i)^(?:true|false)\z"
NUMBER = r"^-?\d+(?:\.\d+)?\z"


# The first letters of month names.
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"


def _loose_date() -> str:
    """Text with a date prefix that the usual lenient date readers accept.

    ISO year-month-day with a strict ``T`` time; or that or month-day-year with one kind of separator, and behind it any
    of: blanks, punctuation, comments in parentheses, the name of a month (it then takes the place of the written month,
    so that the first number may be the day), a zone with its offset, and one time. Days run to 31 in every month here:
    the calendar is checked by ``valid_date``.
    """
    month, day = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
    iso = rf"\d{{4}}-{month}-{day}"
    year = r"(?:\d{4,5}|1\d{5}|2[0-6]\d{4}|27[0-4]\d{3})(?![\d:])-?"
    month_first = rf"{month}(?:/{day}/|-{day}-){year}"
    named = rf"(?:{day}(?:/\d\d/|-\d\d-)|\d\d(?:/{day}/|-{day}-)){year}"
    gap = f"[{SPACE}]"
    midnight = r"24:00(?::00(?:\.0+)?)?"
    strict = rf"[Tt](?:(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?|{midnight})(?:[Zz]|[+-]\d\d:?\d\d)?"
    # letters of a word: all but what stands before them in ASCII, and white space
    letter = rf"[^\x00-\x40{SPACE}]"
    # runs are taken whole and alternations end after 200 turns, so that no text is too long for the matcher's stack
    nested = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\)){0,200}\)){0,200}\)"
    comment = rf"{nested}|\((?:[^()]++|{nested}|\(){{0,200}}\z"
    idle = rf"(?:[{SPACE}!\x22-\x25&\x27*,./;<=>?@:]++|{comment})"
    month_name = rf"(?i:{_MONTHS}){letter}*-?"
    offset = rf"[+-](?:\d{{1,4}}(?![\d:])|\d*:(?:(?:{idle}){{0,9}}[0-5]?\d(?!\d))?)"
    zone = rf"(?:(?i:z|utc?|gmt)(?!{letter})(?:(?:{idle}){{0,9}}{offset})?|(?i:[ecmp][sd]t)(?!{letter}))"
    minute, hour, noon = r"[0-5]?\d", r"(?:[01]?\d|2[0-3])", r"(?:0?\d|1[0-2])"
    # once the last part of a time is read, a blank, a zone or nothing follows
    done = rf"(?=[{SPACE}Zz+\-]|\z)"
    parts = rf":(?:{idle}){{0,9}}{minute}(?:{done}|:(?!(?:{idle}){{0,9}}\d)|:(?:{idle}){{0,9}}{minute}(?:{done}|\.\d+|:\.?(?:{idle}){{0,9}}\d{{1,3}}{done}))"
    clock = rf"(?:{noon}{parts}{gap}+(?i:[ap]m)(?!{letter})|{hour}{parts}|24:(?:{idle}){{0,9}}0?0(?:{done}|:(?:{idle}){{0,9}}0?0(?:{done}|\.0+))|{hour}:(?!(?:{idle}){{0,9}}\d))"
    before, after = rf"(?:{idle}|{month_name}|{zone}){{0,200}}", rf"(?:{idle}|{month_name}|{zone}|{offset}){{0,200}}"
    loose = rf"(?!\d){before}(?:(?<!\d){clock}{after})?"
    by_name = rf"(?!\d){before}(?:{month_name}{before}(?:(?<!\d){clock}{after})?|(?<!\d){clock}{after}{month_name}{after})"
    return rf"^(?:{iso}(?:{strict}|{loose})|{month_first}{loose}|{named}{by_name})\z"


def _calendar_date() -> str:
    """A real calendar date from year 100 on, in one of the accepted layouts."""
    year = r"(?:0[1-9]|[1-9]\d)\d\d"
    leap = r"(?:(?:0[1-9]|[1-9]\d)(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)"
    long_month, short_month = r"(?:0[13578]|1[02])", r"(?:0[469]|11)"
    to28, to30, to31 = r"(?:0[1-9]|1\d|2[0-8])", r"(?:0[1-9]|[12]\d|30)", r"(?:0[1-9]|[12]\d|3[01])"
    time = r"(?:[T ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d)?"
    iso = rf"(?:{year}-(?:{long_month}-{to31}|{short_month}-{to30}|02-{to28})|{leap}-02-29){time}"

    def day_first(sep: str) -> str:
        in_month = rf"(?:{to31}{sep}{long_month}|{to30}{sep}{short_month}|{to28}{sep}02){sep}{year}"
        return rf"{in_month}|29{sep}02{sep}{leap}"

    return rf"^[{SPACE}]*(?:{iso}|{day_first('/')}|{day_first('-')})[{SPACE}]*\z"


LOOSE_DATE = _loose_date()
CALENDAR_DATE = _calendar_date()

# Neither blank nor boolean nor a date in any layout; and the dates among ``LOOSE_DATE`` that are usual.
_PLAIN_TEXT = rf"^(?![{SPACE}tTfF]|\d{{4}}-\d\d-\d\d|\d\d/\d\d/\d{{4}}|\d\d-\d\d-\d{{4}})(?s:.)"
_USUAL_DATE = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[Tt ](?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d)?\z"
_ISO_SHAPE = r"^\d{4}-\d\d-\d\d\z"


def _matches(cell: str, pattern: str) -> str:
    return f"{cell} RLIKE r'{pattern}'"


def is_usable(cell: str) -> str:
    """Present and with at least one visible character (never NULL)."""
    # the first character mostly settles it, without a pattern
    return f"coalesce(substring({cell}, 1, 1) BETWEEN '!' AND '~' OR {_matches(cell, f'[^{SPACE}]')}, false)"


def is_empty(cell: str) -> str:
    """Present, but blank after trimming."""
    return f"({cell} IS NOT NULL AND NOT {is_usable(cell)})"


def value_kind(cell: str) -> str:
    """boolean / number / date / string of a usable cell, as written (untrimmed)."""
    return (
        f"CASE WHEN {_matches(cell, BOOLEAN)} THEN 'boolean' WHEN {_matches(cell, NUMBER)} THEN 'number'"
        f" WHEN {_matches(cell, LOOSE_DATE)} THEN 'date' ELSE 'string' END"
    )


def valid_date(cell: str) -> str:
    """The trimmed cell is a real calendar date in an accepted layout."""
    return _matches(cell, CALENDAR_DATE)


# --- cell codes: everything the audit must know about a present cell, in one character ---

EMPTY, BOOL, NUM = "0", "b", "n"
DATE_OK, DATE_BAD = "D", "d"
TEXT_DATE_OK, TEXT = "S", "s"
KINDS = {"boolean": [BOOL], "number": [NUM], "date": [DATE_OK, DATE_BAD], "string": [TEXT_DATE_OK, TEXT]}
NOT_A_VALID_DATE = [BOOL, NUM, DATE_BAD, TEXT]


def cell_code(cell: str) -> str:
    # what is told from its first characters comes first: ``LOOSE_DATE`` costs ten times as much as the other patterns
    date = f"IF({valid_date(cell)}, '{DATE_OK}', '{DATE_BAD}')"
    return (
        f"CASE WHEN {_matches(cell, NUMBER)} THEN '{NUM}' WHEN {_matches(cell, _PLAIN_TEXT)} THEN '{TEXT}'"
        f" WHEN {_matches(cell, _USUAL_DATE)} THEN {date}"
        f" WHEN NOT {_matches(cell, f'[^{SPACE}]')} THEN '{EMPTY}' WHEN {_matches(cell, BOOLEAN)} THEN '{BOOL}'"
        f" WHEN {_matches(cell, '^[0-9]')} AND {_matches(cell, LOOSE_DATE)} THEN {date}"
        f" WHEN {valid_date(cell)} THEN '{TEXT_DATE_OK}' ELSE '{TEXT}' END"
    )


def _code_aside(cell: str) -> str:
    """``cell_code`` worked out in a function of its own: generated code that holds its patterns is too long to be compiled."""
    return f"get(transform(array({cell}), own -> {cell_code('own')}), 0)"


def _quick_code(cell: str) -> str:
    """``cell_code`` with what most cells are told by in generated code, and only the rest aside."""
    first, size = f"substring({cell}, 1, 1)", f"octet_length({cell})"
    letter = f"({first} BETWEEN 'A' AND 'Z' OR {first} BETWEEN 'a' AND 'z')"
    dashed = f"{size} = 10 AND substring({cell}, 5, 1) = '-' AND substring({cell}, 8, 1) = '-'"
    return (
        # only ``true`` and ``false`` are no texts among what begins with a letter
        f"CASE WHEN {size} NOT IN (4, 5) AND {letter} THEN '{TEXT}'"
        f" WHEN {first} <= ' ' AND NOT {_matches(cell, f'[^{SPACE}]')} THEN '{EMPTY}'"
        # year-month-day: no other layout is as long and has its dashes there, so what is not usual is no date
        f" WHEN {dashed} AND {valid_date(cell)} THEN '{DATE_OK}'"
        f" WHEN {dashed} AND {_matches(cell, _ISO_SHAPE)} THEN IF({_matches(cell, _USUAL_DATE)}, '{DATE_BAD}', '{TEXT}')"
        # the sign of a number stands in front
        f" WHEN instr({cell}, '-') < 2 AND {_matches(cell, NUMBER)} THEN '{NUM}'"
        f" WHEN {_matches(cell, _PLAIN_TEXT)} THEN '{TEXT}' ELSE {_code_aside(cell)} END"
    )


# Values up to this many bytes travel as they are; longer ones as code + SHA-256, which is
# one byte longer than any short value, so the two cannot be confused.  Keys are typed as text, as equal texts are
# counted faster than equal binaries, but those of long values and rows hold the bytes of the digest as they are.
SHORT_BYTES = 32
_DIGEST_BYTES = SHORT_BYTES + 1
_ROW = "r"


def _digest(text: str) -> str:
    return f"CAST(unhex(sha2({text}, 256)) AS STRING)"


def cell_key(cell: str) -> str:
    """Identity of a cell value in at most 33 bytes, with its code when it is long."""
    # a long text whose first character is no digit, sign or space needs no further look
    plain = _matches(f"substring({cell}, 1, 1)", rf"[^{SPACE}0-9\-]")
    return (
        f"CASE WHEN octet_length({cell}) <= {SHORT_BYTES} THEN {cell} WHEN {cell} IS NOT NULL THEN"
        f" concat(CASE WHEN {plain} THEN '{TEXT}' ELSE {_code_aside(cell)} END, {_digest(cell)}) END"
    )


def row_key(cells: Iterable[str]) -> str:
    """Identity of a whole row; missing and empty cells differ, and no two cells can run together."""
    return f"concat('{_ROW}', {_digest(f'concat({cells_joined(cells)})')})"


def cells_joined(cells: Iterable[str]) -> str:
    """The parts of a text that tells whole rows apart."""
    return ", ".join(f"coalesce(concat(octet_length({c}), ':', {c}), '-')" for c in cells)


def array_key(cells: str) -> str:
    """``row_key`` of cells in an array."""
    parts = f"array_join(transform({cells}, c -> coalesce(concat(octet_length(c), ':', c), '-')), '')"
    return f"concat('{_ROW}', {_digest(parts)})"


def key_code(key: str) -> str:
    """The code of the value behind a key; NULL for a missing cell, ``r`` for a row."""
    return (
        f"CASE WHEN octet_length({key}) = {_DIGEST_BYTES} THEN substring({key}, 1, 1)"
        f" WHEN {key} IS NOT NULL THEN {_quick_code(key)} END"
    )


def coded_key(cell: str) -> str:
    """The code of a cell and, behind it, its value or, of a long one, its SHA-256, longer than any short value; NULL for
    a missing cell."""
    value = f"IF(octet_length({cell}) <= {SHORT_BYTES}, {cell}, sha2({cell}, 256))"
    return f"CASE WHEN {cell} IS NOT NULL THEN concat({_quick_code(cell)}, {value}) END"


def coded_key_code(key: str) -> str:
    return f"substring({key}, 1, 1)"
