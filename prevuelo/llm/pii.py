"""Personal data replaced by format-preserving pseudonyms, in SQL expressions only.

Numbers and dates that pass their check are moved by a keyed Feistel permutation within their own format, so the same
value gets the same pseudonym in every document, different values stay different, and the result passes the check too:

- payment cards: 13 to 19 digits, plain, 16 in fours, or 14 and 15 as 4-6-4 and 4-6-5, with a right check digit, which is
  computed anew
- telephone numbers: three, three and four digits with or without +country; +country and a number in any groups, 8 to 15
  digits in all; the country stays
- IPv4 addresses with octets up to 255
- social security numbers with a possible area, group and serial
- calendar dates from 1900 to 2099: y-m-d, y/m/d, d/m/y (else m/d/y), d.m.y, with one or two digits of day and month; a time
  behind y-m-d stays

- account numbers (IBAN) with right check digits, which are computed anew

E-mail names are permuted as texts: digits, letters and accented letters each within their kind, by a Feistel network of
the name's halves, so different names stay different. Secrets (cloud keys and tokens of known forms; bearer tokens;
values after names that have token, password, secret or api key as a part, in quotes or not) have each letter and digit
shifted by a keyed hash of the whole value. What fails its check stays as it is.

A permutation works on a pair (l, r) of numbers below (a, b): eight rounds add a keyed SHA-256 of the one to the other,
modulo its bound. So every a x b values are permuted exactly, without walking or tables.

A null text stays null, an empty one empty. All columns are kept, whatever
their names. Repeated rows stay rows. The work is linear in the text: every pattern begins at the border of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevuelo.llm.store import free

KEY = "prevuelo"
ROUNDS = 8

# What a candidate of each kind looks like, as Java patterns.
_START, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": _START + r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{22,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk-[0-9A-Za-z_-]{20,}"
    + r"|(?i:bearer)[ ]{1,3}(?=[0-9A-Za-z._~+/-]{0,99}\d)[0-9A-Za-z._~+/-]{15,}[0-9A-Za-z]"
    + r"|(?:[0-9A-Za-z]{1,20}[_-]){0,5}(?i:token|password|passwd|secret|api[_-]?key)(?:[_-][0-9A-Za-z]{1,20}){0,5}(?:\\?[\"'])?\s{0,3}[=:]\s{0,3}(?:\\?[\"'])?[0-9A-Za-z_/+-]{8,})" + _END,
    "iban": _START + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "phone": r"(?<![\p{L}\p{N}+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _END + r"|(?<![\p{L}\p{N}+])\+[1-9](?:(?:[ .-]?\(|\)[ .-]?|[ ./-])?\d){7,14}" + _END,
    "ip": r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?[\p{L}\p{N}])",
    "date": _START + r"(?:\d{4}-\d{2}-\d{2}(?:(?=[Tt]\d{2}:?\d{2})|" + _END + r")|(?:\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})" + _END
    + r"|(?<!\d[./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![./-]?[\p{N}]|\p{L}))",
    "ssn": _START + r"\d{3}-\d{2}-\d{4}" + _END,
    "card": _START + r"(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5}|\d{13,19})" + _END,
}
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: 200 years from 1900 are 73 049 days, 17 x 4297.
_DAYS = (17, 4297)
#: Areas 001-665 and 667-899, groups 01-99, serials 0001-9999.
_SSN = (898 * 99, 9999)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any() -> str:
    # the card's groups are the only ones, whatever stands before it
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def _hash(key: str, kind: str, *parts: str) -> str:
    """A keyed number below 2^60."""
    joined = ", ".join([_quoted(key), _quoted(kind), *(f"CAST({p} AS STRING)" for p in parts)])
    return f"CAST(conv(substr(sha2(concat_ws(':', {joined}), 256), 1, 15), 16, 10) AS BIGINT)"


def feistel(left: str, right: str, a: str, b: str, key: str, kind: str) -> str:
    """SQL of a struct (l, r): the permuted pair of numbers below (a, b)."""
    odd = f"named_struct('l', pmod(s.l + {_hash(key, kind, 'i', 's.r')}, CAST({a} AS BIGINT)), 'r', s.r)"
    even = f"named_struct('l', s.l, 'r', pmod(s.r + {_hash(key, kind, 'i', 's.l')}, CAST({b} AS BIGINT)))"
    start = f"named_struct('l', CAST({left} AS BIGINT), 'r', CAST({right} AS BIGINT))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> IF(i % 2 = 1, {odd}, {even}))"


def _with(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(text: str, key: str, kind: str) -> str:
    """SQL of the permuted digits of a string of 2 to 19 digits."""
    low = "(length(d) DIV 2)"
    ten = lambda n: f"CAST(rpad('1', {n} + 1, '0') AS BIGINT)"
    pair = feistel(f"substr(d, 1, length(d) - {low})", f"right(d, {low})", ten(f"(length(d) - {low})"), ten(low), key, f"{kind}")
    body = _with(pair, "p", f"concat(lpad(CAST(p.l AS STRING), length(d) - {low}, '0'), lpad(CAST(p.r AS STRING), {low}, '0'))")
    return _with(text, "d", body)


def _luhn(digits: str) -> str:
    """SQL of the sum that a right check digit makes a multiple of ten."""
    value = "CAST(c AS INT) * IF(i % 2 = 1, 2, 1)"
    return f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> ({value}) DIV 10 + ({value}) % 10), 0L, (x, y) -> x + y)"


def _refill(text: str, digits: str) -> str:
    """SQL of ``text`` with its digits replaced, in order."""
    # place of each digit: digits up to and with it
    place = f"length(regexp_replace(substr({text}, 1, i + 1), '[^0-9]', ''))"
    return _with(digits, "q", f"array_join(transform(split({text}, ''), (c, i) -> IF(c RLIKE '[0-9]', substr(q, {place}, 1), c)), '')")


def _only_digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _shifted(text: str, key: str, kind: str) -> str:
    """SQL of ``text`` with every letter and digit shifted by a hash of the whole; never itself."""
    h = _hash(key, kind, f"lower({text})", "i")
    span = f"IF({text} RLIKE '^[0-9a-f]+$', 6, 26)"
    letter = lambda base: f"char({base} + pmod(ascii(c) - {base} + 1 + pmod({h}, {span} - 1), {span}))"
    case = (
        f"CASE WHEN c RLIKE '[0-9]' THEN CAST(pmod(CAST(c AS INT) + 1 + pmod({h}, 9), 10) AS STRING) "
        f"WHEN c RLIKE '[A-Z]' THEN char(65 + pmod(ascii(c) - 65 + 1 + pmod({h}, 25), 26)) "
        f"WHEN c RLIKE '[a-z]' THEN {letter(97)} WHEN c RLIKE '\\\\p{{L}}' THEN char(97 + pmod({h}, 26)) ELSE c END"
    )
    return f"array_join(transform(split({text}, ''), (c, i) -> {case}), '')"


def _permuted(text: str, key: str, kind: str) -> str:
    """SQL of ``text`` with its letters and digits permuted within their kinds, one to one whatever the case of letters.

    A Feistel network of two halves: each is shifted, character by character, by a keyed hash of the other.
    """
    by = lambda half: f"sha2(concat_ws(':', {_quoted(key)}, {_quoted(kind)}, CAST(i AS STRING), lower({half})), 256)"

    def moved(half: str, other: str) -> str:
        step = "CAST(conv(substr(h, (j % 31) * 2 + 1, 3), 16, 10) AS INT)"
        turn = lambda base, size: f"char({base} + pmod(ascii(c) - {base} + {step}, {size}))"
        case = (
            f"CASE WHEN c RLIKE '[0-9]' THEN {turn(48, 10)} WHEN c RLIKE '[A-Z]' THEN {turn(65, 26)} WHEN c RLIKE '[a-z]' THEN {turn(97, 26)} "
            f"WHEN c RLIKE '[\u00e0-\u00f6]' THEN {turn(224, 23)} ELSE c END"
        )
        return _with(by(other), "h", f"array_join(transform(split({half}, ''), (c, j) -> {case}), '')")

    odd = f"named_struct('l', {moved('s.l', 's.r')}, 'r', s.r)"
    even = f"named_struct('l', s.l, 'r', {moved('s.r', 's.l')})"
    start = "named_struct('l', left(t, length(t) DIV 2), 'r', substr(t, length(t) DIV 2 + 1))"
    done = f"aggregate(sequence(1, 4), {start}, (s, i) -> IF(i % 2 = 1, {odd}, {even}))"
    return _with(text, "t", _with(done, "p", "concat(p.l, p.r)"))


def _mod97(text: str) -> str:
    """SQL of the remainder of an account number's text of digits and capital letters (A is 10, B is 11, ...)."""
    grown = "IF(c RLIKE '[0-9]', (x * 10 + CAST(c AS INT)) % 97, (x * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(split({text}, ''), 0, (x, c) -> {grown})"


def _iban(key: str) -> str:
    """SQL of the permuted account number of match ``m``: its digits move, its check digits are right, letters stay."""
    right = f"{_mod97('concat(substr(a, 5), left(a, 4))')} = 1"
    # behind the check digits: up to 18 digits, and what there is beyond them
    first, rest = _digits("left(d, least(18, length(d)))", key, "iban"), _digits("substr(d, 19)", key, "iban-rest")
    digits = _with(_only_digits("substr(a, 5)"), "d", f"concat({first}, IF(length(d) > 19, {rest}, substr(d, 19)))")
    body = _refill("substr(a, 5)", digits)
    check = f"lpad(CAST(98 - {_mod97('concat(b, left(a, 2), ' + _quoted('00') + ')')} AS STRING), 2, '0')"
    number = _with(body, "b", f"concat(left(a, 2), {check}, b)")
    # blanks stand where they stood
    place = "length(replace(left(m, i + 1), ' ', ''))"
    spaced = _with(number, "q2", f"array_join(transform(split(m, ''), (c, i) -> IF(c = ' ', c, substr(q2, {place}, 1))), '')")
    enough = "length(regexp_replace(substr(a, 5), '[^0-9]', '')) > 3 AND length(a) BETWEEN 15 AND 34"
    return _with("replace(m, ' ', '')", "a", f"IF({enough} AND {right}, {spaced}, NULL)")


def _date(key: str) -> str:
    """SQL of the permuted date of match ``m``, null where it is none."""

    def moved(read: str, form: str) -> str:
        day = "datediff(d, DATE'1900-01-01')"
        pair = feistel(f"{day} DIV {_DAYS[1]}", f"{day} % {_DAYS[1]}", str(_DAYS[0]), str(_DAYS[1]), key, "date")
        out = _with(pair, "p", f"date_format(date_add(DATE'1900-01-01', CAST(p.l * {_DAYS[1]} + p.r AS INT)), '{form}')")
        return _with(read, "d", f"IF(d BETWEEN DATE'1900-01-01' AND DATE'2099-12-31', {out}, NULL)")

    y_m_d = moved("try_to_date(w, 'yyyy-MM-dd')", "yyyy-MM-dd")
    slashed = moved("try_to_date(w, 'yyyy/MM/dd')", "yyyy/MM/dd")
    d_m_y = moved("try_to_date(w, 'dd/MM/yyyy')", "dd/MM/yyyy")
    m_d_y = moved("try_to_date(w, 'MM/dd/yyyy')", "MM/dd/yyyy")
    dots = moved("try_to_date(w, 'dd.MM.yyyy')", "dd.MM.yyyy")
    # w: two digits of day and month; where m has fewer, the result has no leading zeros
    wide = f"IF(length(m) = 10, m, regexp_replace(m, {_quoted(r'\b(\d)\b')}, '0$1'))"
    out = _with(wide, "w", f"CASE WHEN w LIKE '____-%' THEN {y_m_d} WHEN w LIKE '____/%' THEN {slashed} WHEN w LIKE '__/%' THEN coalesce({d_m_y}, {m_d_y}) ELSE {dots} END")
    return _with(out, "o", f"IF(length(m) = 10, o, regexp_replace(o, {_quoted(r'\b0')}, ''))")


def pseudonym(key: str) -> str:
    """SQL of the replacement of match ``m``; null where it fails its check."""
    email = f"concat({_permuted(_part(1, '^(.*)@'), key, 'email')}, {_part(1, '(@.*)$')})"
    head = _part(1, r"^(AKIA|gh[pousr]_|github_pat_|xox[abprs]-|sk-|(?i:bearer)[ ]+|[^=:]*[=:]\s*(?:\\?[\"'])?)")
    secret = _with(head, "h", f"concat(h, {_with('substr(m, length(h) + 1)', 'v', _shifted('v', key, 'secret'))})")
    country = _part(1, rf"^({_COUNTRY}|\+\d{{1,3}}(?=[ .(-]))")
    phone = _with(country, "h", f"concat(h, {_with('substr(m, length(h) + 1)', 'v', _refill('v', _digits(_only_digits('v'), key, 'phone')))})")
    octet = lambda i: f"CAST(element_at(split(m, '[.]'), {i}) AS INT)"
    pair = feistel(f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", "65536", "65536", key, "ip")
    ip = f"IF({' AND '.join(f'{octet(i)} < 256' for i in range(1, 5))}, {_with(pair, 'p', _dotted())}, NULL)"
    area, group, serial = "CAST(substr(m, 1, 3) AS INT)", "CAST(substr(m, 5, 2) AS INT)", "CAST(right(m, 4) AS INT)"
    pair = feistel(f"({area} - IF({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", str(_SSN[0]), str(_SSN[1]), key, "ssn")
    number = "p.l DIV 99 + IF(p.l DIV 99 >= 665, 2, 1)"
    out = f"concat_ws('-', lpad(CAST({number} AS STRING), 3, '0'), lpad(CAST(p.l % 99 + 1 AS STRING), 2, '0'), lpad(CAST(p.r + 1 AS STRING), 4, '0'))"
    ssn = f"IF({area} IN (0, 666) OR {area} >= 900 OR {group} = 0 OR {serial} = 0, NULL, {_with(pair, 'p', out)})"
    body = _digits("substr(n, 1, length(n) - 1)", key, "card")
    open_sum = _luhn("concat(b, '0')")
    checked = _with(body, "b", f"concat(b, CAST(pmod(-{open_sum}, 10) AS STRING))")
    card = _with(_only_digits("m"), "n", f"IF({_luhn('n')} % 10 = 0 AND NOT n RLIKE '^(.)\\\\1*$', {_refill('m', checked)}, NULL)")
    is_ = lambda kind: f"m RLIKE {_quoted('^(?:' + PATTERNS[kind] + ')$')}"
    cases = {"email": email, "secret": secret, "iban": _iban(key), "phone": phone, "ip": ip, "date": _date(key), "ssn": ssn, "card": card}
    return "CASE " + " ".join(f"WHEN {is_(k)} THEN {v}" for k, v in cases.items()) + " END"


def _part(group: int, pattern: str) -> str:
    return f"regexp_extract(m, {_quoted(pattern)}, {group})"


def _dotted() -> str:
    return "concat_ws('.', p.l DIV 256, p.l % 256, p.r DIV 256, p.r % 256)"


def pseudonymise(df: DataFrame, text: str = "text", key: str = KEY, count: str | None = None) -> DataFrame:
    """``df`` with its texts pseudonymised, and, if named, a column with the number of replaced values."""
    found, new, gaps = (free(df, n) for n in ("_found", "_new", "_gaps"))
    rows = df.withColumn(found, F.regexp_extract_all(text, F.lit(_any()), F.lit(0)))
    rows = rows.withColumn(new, F.expr(f"IF(size({found}) > 0, transform({found}, m -> {pseudonym(key)}), NULL)"))
    rows = rows.withColumn(gaps, F.when(F.exists(new, lambda x: x.isNotNull()), F.split(F.col(text), _any(), -1)))
    merged = F.expr(f"array_join(transform({gaps}, (g, i) -> concat(g, coalesce(get({new}, i), get({found}, i), ''))), '')")
    out = rows.withColumn(text, F.coalesce(merged, F.col(text)))
    if count:
        out = out.withColumn(count, F.coalesce(F.size(F.filter(new, lambda x: x.isNotNull())), F.lit(0)))
    return out.select(*df.columns, *([count] if count and count not in df.columns else []))


def op6(df: DataFrame) -> DataFrame:
    return pseudonymise(df.select("doc_id", "text"), count="n_replaced")
