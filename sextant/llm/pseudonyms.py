"""Personal data replaced by format-preserving pseudonyms, in SQL expressions only.

One pattern finds candidates; each is validated by its kind, and what validates is permuted within its own format by a
keyed Feistel network, so that equal values stay equal in all documents and nothing else about the text changes.

A value is a row of symbols, each with its own radix; separators have radix 1. Even and odd places are the two halves:
a round adds to every symbol of one half, modulo its radix, a number from the other half. That is a bijection for any mix
of radices, and subtracting in reverse order is its inverse. The numbers are SHA-256 of the symbol's place and of the
round's digest, which is SHA-256 of the key, the kind, the round and the other half: without the key nothing can be undone,
and with it everything. The key stands in the query's plan; keep both from those who may not see the values.

Kinds and what their formats keep:
- card numbers (13-19 digits, an issuer's prefix and length, Luhn): length, separators and the first four digits, which name
  the issuer; the last digit is the new check digit. In a run of groups of digits, such as a number and its security code,
  the first and longest row of groups that validates is one.
- phone numbers (North American): layout; area and exchange codes stay in the range they are in.
- addresses of hosts (IPv4, octets to 255): the number of digits of each octet.
- social security numbers (assigned ranges): layout and ranges.
- dates (year-month-day, or day and month of two digits and year, separated by / or .), from the year 400 on: layout and the cycle of
  400 years, inside which days are permuted. What is a date only with the month first stays so.
- bank accounts (IBAN, modulo 97): country, letters and digits; with new check digits.
- mail addresses: the domain's last label, and the kind of each character before it.
- access keys and values after password, token, secret or key: prefix, length, alphabet and punctuation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ROUNDS = 8
#: Most steps of a walk to a day over 12, which three days in five are.
WALK = 64

MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ACCESS = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?i:pass(?:word|wd)|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[\w./+=-]{0,7}[A-Za-z0-9])[A-Za-z0-9_./+=-]{8,}+"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}([/.])\d{2}\1\d{4})(?!\d)"
_DAY = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d)"  # DATE without its group
HOST = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
PHONE = r"(?<![\d(])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4}(?!\d)"
# a run goes on to where another kind begins; possessive, as Java then loops where it would recurse
CARD = rf"(?<!\d)(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{MAIL}|{SOCIAL}|{_DAY}|{HOST}|{PHONE})\d++)*+"
# Prefixes and lengths of the issuers' numbers, as published.
ISSUED = (
    r"^(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|(?:222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11,16}|35(?:2[89]|[3-8]\d)\d{12,15}"
    r"|(?:6011|64[4-9]\d|65\d\d|62\d\d)\d{12,15}|(?:50[0-9]{2}|5[6-8]\d\d|6304|6759|676[1-3])\d{9,15})$"
)
ANY = "|".join((MAIL, IBAN, ACCESS, SECRET, SOCIAL, DATE, HOST, PHONE, CARD))


def _whole(pattern: str, x: str = "m") -> str:
    return f"{x} rlike {_text(f'^(?:{pattern})$')}"


def _text(s: str) -> str:
    """An SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _network(symbols: str, kind: str, key: str, back: bool) -> str:
    """The Feistel network on an array of (r radix, d digit, a alphabet)."""
    rounds = f"sequence({ROUNDS}, 1, -1)" if back else f"sequence(1, {ROUNDS})"
    other = "concat_ws(',', transform(filter(s, (y, k) -> (k + i) % 2 = 0), y -> cast(y.d as string)))"
    # 60 bits of a digest: for radices to 9999 the bias is nothing
    shift = "cast(conv(substring(sha2(concat(h, cast(j as string)), 256), 1, 15), 16, 10) as bigint) % x.r"
    moved = f"(x.d {'-' if back else '+'} {shift})"
    turn = f"transform(s, (x, j) -> if((j + i) % 2 = 0, x, named_struct('r', x.r, 'd', pmod({moved}, x.r), 'a', x.a)))"
    digest = f"sha2(concat({_text(key + ':' + kind + ':')}, cast(i as string), ':', {other}), 256)"
    # the other half's digest is taken once a round: a one-element transform serves as a binding
    return f"aggregate({rounds}, {symbols}, (s, i) -> transform(array({digest}), h -> {turn})[0])"


def _symbol(alphabet: str, c: str = "c") -> str:
    return f"named_struct('r', {len(alphabet)}L, 'd', cast(instr({_text(alphabet)}, {c}) - 1 as bigint), 'a', {_text(alphabet)})"


_FIXED = "named_struct('r', 1L, 'd', 0L, 'a', c)"
_CHARACTERS = "transform(sequence(1, length({x})), p -> substring({x}, p, 1))"


def _by_class(hexadecimal: bool = False) -> str:
    """A symbol of a character c by its class."""
    if hexadecimal:
        return f"case when {{low}} then {_symbol('0123456789abcdef')} else {_symbol('0123456789ABCDEF')} end"
    return " ".join(["case", *(f"when instr('{a}', c) > 0 then {_symbol(a)}" for a in (DIGITS, LOWER, UPPER)), f"else {_FIXED} end"])


def _spell(symbols: str) -> str:
    return f"array_join(transform({symbols}, y -> substring(y.a, cast(y.d as int) + 1, 1)), '')"


def _luhn(digits: str) -> str:
    """Sum for Luhn's check, of digits whose last one counts once."""
    value = "cast(substring(reverse(n), p, 1) as int)"
    return f"transform(array({digits}), n -> aggregate(sequence(1, length(n)), 0, (t, p) -> t + if(p % 2 = 1, {value}, {value} * 2 - if({value} > 4, 9, 0))))[0]"


def _mod97(x: str) -> str:
    """An account's digits, country and check last, modulo 97: letters count 10 to 35."""
    value = f"(instr('{DIGITS}{UPPER}', c) - 1)"
    return f"aggregate({_CHARACTERS.format(x=x)}, 0, (t, c) -> (t * if({value} > 9, 100, 10) + {value}) % 97)"


def _chars(x: str, symbol: str, kind: str, key: str, back: bool) -> str:
    return _spell(_network(f"transform({_CHARACTERS.format(x=x)}, (c, q) -> {symbol})", kind, key, back))


def _fields(fields: list[tuple[str, str]], out: str, kind: str, key: str, back: bool) -> str:
    """Numeric fields (radix, digit) permuted and spelt by out, in which f is their array."""
    symbols = ", ".join(f"named_struct('r', cast({r} as bigint), 'd', cast({d} as bigint), 'a', '')" for r, d in fields)
    return f"transform(array({_network(f'array({symbols})', kind, key, back)}), f -> {out})[0]"


def _card(key: str, back: bool) -> str:
    nth = "length(regexp_replace(substring(m, 1, q + 1), '[^0-9]', ''))"  # of the digits, from 1
    symbol = f"case when c in (' ', '-') or q = length(m) - 1 or {nth} <= 4 then {_FIXED} else {_symbol(DIGITS)} end"
    new = _chars("m", symbol, "card", key, back)
    body = "substring(w, 1, length(w) - 1)"
    check = f"pmod(-({_luhn(f'''concat(regexp_replace({body}, '[ -]', ''), '0')''')}), 10)"
    card = f"transform(array({new}), w -> concat({body}, cast({check} as string)))[0]"
    # groups keep the separator behind them; from each on, the longest row of groups that validates is a card
    groups = "regexp_extract_all(run, '[0-9]+[ -]?', 0)"
    text = "array_join(slice(g, {i}, {k}), '')"
    valid = f"transform(array(regexp_replace({text.format(i='i', k='k')}, '[ -]', '')), d -> d rlike {_text(ISSUED)} and {_luhn('d')} % 10 = 0)[0]"
    longest = f"coalesce(get(filter(sequence(least(19, size(g) - i + 1), 1, -1), k -> {valid}), 0), 0)"
    step = f"if(i < a.next, a, transform(array({longest}), k -> if(k = 0, a, named_struct('next', i + k, 'spans', concat(a.spans, array(named_struct('i', i, 'k', k, 'after', a.next))))))[0])"
    spans = f"aggregate(sequence(1, size(g)), named_struct('next', 1, 'spans', cast(array() as array<struct<i: int, k: int, after: int>>)), (a, i) -> {step})"
    one = f"transform(array(rtrim(' -', {text.format(i='p.i', k='p.k')})), m -> concat({text.format(i='p.after', k='p.i - p.after')}, {card}, substring({text.format(i='p.i', k='p.k')}, length(m) + 1)))[0]"
    spelt = f"concat(array_join(transform(f.spans, p -> {one}), ''), {text.format(i='f.next', k='size(g) - f.next + 1')})"
    return f"transform(array(m), run -> transform(array({groups}), g -> transform(array({spans}), f -> {spelt})[0])[0])[0]"


def _phone(key: str, back: bool) -> str:
    high, low = _symbol("23456789"), _symbol("01")
    place = "length(regexp_replace(substring(m, q + 1), '[^0-9]', ''))"  # digits from here on, this one included
    first = f"case when c in ('0', '1') then {low} else {high} end"
    symbol = f"case when instr('{DIGITS}', c) = 0 or {place} > 10 then {_FIXED} when {place} in (10, 7) then {first} else {_symbol(DIGITS)} end"
    return _chars("m", symbol, "phone", key, back)


def _host(key: str, back: bool) -> str:
    part = [f"split(m, '[.]')[{k}]" for k in range(4)]
    base = [f"if(length({p}) = 1, 0, if(length({p}) = 2, 10, 100))" for p in part]
    radix = [f"if(length({p}) = 1, 10, if(length({p}) = 2, 90, 156))" for p in part]
    out = f"concat_ws('.', {', '.join(f'cast(f[{k}].d + {base[k]} as string)' for k in range(4))})"
    valid = " and ".join(f"cast({p} as int) <= 255 and cast({p} as int) >= {b}" for p, b in zip(part, base, strict=True))
    return f"if({valid}, {_fields([(r, f'cast({p} as int) - {b}') for r, p, b in zip(radix, part, base, strict=True)], out, 'host', key, back)}, m)"


def _social(key: str, back: bool) -> str:
    a, g, n = (f"cast(substring(m, {i}, {k}) as int)" for i, k in ((1, 3), (5, 2), (8, 4)))
    out = "concat_ws('-', lpad(cast(f[0].d + if(f[0].d >= 665, 2, 1) as string), 3, '0'), lpad(cast(f[1].d + 1 as string), 2, '0'), lpad(cast(f[2].d + 1 as string), 4, '0'))"
    fields = [("898", f"{a} - if({a} > 666, 2, 1)"), ("99", f"{g} - 1"), ("9999", f"{n} - 1")]
    return f"if({a} between 1 and 899 and {a} <> 666 and {g} > 0 and {n} > 0, {_fields(fields, out, 'social', key, back)}, m)"


def _date(key: str, back: bool) -> str:
    iso = "substring(m, 5, 1) = '-'"
    parsed = lambda form: f"try_to_date(concat(substring(m, 1, 2), '-', substring(m, 4, 2), '-', substring(m, 7)), '{form}')"
    day = f"if({iso}, try_to_date(m, 'yyyy-MM-dd'), {parsed('dd-MM-yyyy')})"
    whole = "146097"  # days of 400 years, 189 times 773

    def new(d: str, kind: str) -> str:
        since = f"datediff({d}, date'0400-01-01')"
        out = f"date_add(date'0400-01-01', cast(({since} div {whole}) * {whole} + f[0].d * 773 + f[1].d as int))"
        return _fields([("189", f"({since} % {whole}) div 773"), ("773", f"({since} % {whole}) % 773")], out, kind, key, back)

    spelt = lambda *parts: "concat_ws(substring(m, 3, 1), " + ", ".join(f"date_format(u, '{x}')" for x in parts) + ")"
    first = f"transform(array({new('t', 'date')}), u -> if({iso}, date_format(u, 'yyyy-MM-dd'), {spelt('dd', 'MM', 'yyyy')}))[0]"
    # month first, with a day over 12: permuted among such days alone, by walking until one is met
    walk = f"aggregate(sequence(2, {WALK}), {new('t', 'month')}, (v, step) -> if(day(v) > 12, v, {new('v', 'month')}))"
    month = f"transform(array({walk}), u -> {spelt('MM', 'dd', 'yyyy')})[0]"
    american = f"transform(array({parsed('MM-dd-yyyy')}), t -> if(t >= date'0400-01-01', {month}, m))[0]"
    return f"transform(array({day}), t -> case when t >= date'0400-01-01' then {first} when t is null and not {iso} then {american} else m end)[0]"


def _iban(key: str, back: bool) -> str:
    bare = "regexp_replace({x}, ' ', '')"
    turned = lambda x: f"concat(substring({bare.format(x=x)}, 5), substring({bare.format(x=x)}, 1, 4))"
    new = _chars("m", f"case when q < 4 then {_FIXED} else {_by_class()} end", "iban", key, back)
    check = f"98 - {_mod97(f'''concat(substring({bare.format(x='w')}, 5), substring(w, 1, 2), '00')''')}"
    # an account's check digits run from 02 to 98; others that agree modulo 97 are not valid
    valid = f"({_mod97(turned('m'))}) = 1 and cast(substring(m, 3, 2) as int) between 2 and 98"
    return f"if({valid}, transform(array({new}), w -> concat(substring(w, 1, 2), lpad(cast({check} as string), 2, '0'), substring(w, 5)))[0], m)"


def _secret(key: str, back: bool) -> str:
    value = "regexp_extract(m, '[=:][^A-Za-z0-9_./+=-]*(.*)$', 1)"  # behind the first sign after the keyword
    forms = (("v rlike '^[0-9a-f]+$'", _symbol("0123456789abcdef"), "hex"), ("v rlike '^[0-9A-F]+$'", _symbol("0123456789ABCDEF"), "Hex"), ("true", _by_class(), "word"))
    new = " ".join(["case", *(f"when {test} then {_chars('v', symbol, kind, key, back)}" for test, symbol, kind in forms), "end"])
    return f"transform(array({value}), v -> concat(substring(m, 1, length(m) - length(v)), {new}))[0]"


def pseudonym(key: str, back: bool = False) -> str:
    """SQL for the pseudonym of m, one match of ANY; back: the value of a pseudonym. What doesn't validate stays."""
    name, domain, last = "substring_index(m, '@', 1)", "regexp_extract(m, '@(.*)[.]', 1)", "substring_index(m, '.', -1)"
    mail = f"concat({_chars(name, _by_class(), 'mail', key, back)}, '@', {_chars(domain, _by_class(), 'domain', key, back)}, '.', {last})"
    access = f"concat('AKIA', {_chars('substring(m, 5)', _symbol(UPPER + DIGITS), 'access', key, back)})"
    kinds = ((MAIL, mail), (IBAN, _iban(key, back)), (ACCESS, access), (SECRET, _secret(key, back)), (SOCIAL, _social(key, back)), (DATE, _date(key, back)), (HOST, _host(key, back)), (PHONE, _phone(key, back)))
    return " ".join(["case", *(f"when {_whole(p)} then {x}" for p, x in kinds), f"else {_card(key, back)} end"])


def pseudonymised(docs: DataFrame, key: str, back: bool = False, text: str = "text") -> DataFrame:
    """docs with its text column replaced, other columns untouched, under a key that the caller keeps secret; back restores
    the text.

    A card beside other groups of digits is not always restored: its pseudonym may validate together with them.
    Null stays null and empty stays empty; rows don't affect each other. What the pattern finds but its kind doesn't
    validate is left as it is, as is everything else in the text. Where several kinds could begin, the first of the list
    above is taken. A text of any length is taken whole, in time in proportion to it. An empty table gives an empty one.
    """
    # the pattern is applied twice: once to take the values, once to take what is between them
    column = f"`{text}`"
    name = "_found"
    while name in docs.columns:
        name += "_"
    found = F.expr(f"regexp_extract_all({column}, {_text(ANY)}, 0)")
    swapped = F.expr(
        f"array_join(zip_with(split({column}, {_text(ANY)}, -1), transform({name}, m -> {pseudonym(key, back)}), (b, v) -> concat(b, coalesce(v, ''))), '')"
    )
    return docs.withColumn(name, found).withColumn(text, F.when(F.size(name) > 0, swapped).otherwise(F.col(column))).drop(name)


def pseudonym_of(column: str, key: str, back: bool = False) -> Column:
    """The pseudonym of a column, given by its SQL, that holds one value each."""
    return F.expr(f"transform(array({column}), m -> {pseudonym(key, back)})[0]")
