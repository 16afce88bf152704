"""PII: format-preserving Feistel pseudonyms, in SQL expressions only.

Personal data are found by pattern and validated: payment cards (Luhn), IBANs (mod 97), IPv4
addresses (octets), US social security numbers (ranges), calendar dates, telephone numbers and e-mail
addresses. What fails its check is left alone.

A validated value is a number in a mixed radix MA x MB. Rounds of a Feistel network add a keyed hash of
one half (HMAC-SHA256) to the other, modulo its radix, in turn; that is a permutation of just these values for any radices.
So a pseudonym has the same format and passes the same check, different values get different
pseudonyms, and equal values get equal ones in every document. Whoever has the key can invert all but e-mail
addresses (`restore`): a pseudonym is found where the value was, and the rounds run backwards.

* card: all digits but the last are permuted, the last is the new Luhn digit
* IBAN: country kept, digits of the account permuted, check digits made anew; its length is that of its country, where listed
* IPv4: 2^16 x 2^16; SSN: valid areas x (groups x serials); telephone: the digits after the country code
* date: 75 x 487 days, the 36,525 days from 1950 to 2049; other dates move within their own such span. Dates outside
  the 99 spans from December 49 to 9950 are not taken for dates.
* e-mail address: it has no numeric format; the part before the @ becomes a keyed hash, the domain stays.

A null text stays null. Texts without a digit or @ are not searched further.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_L, _R = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"

# Characters of an IBAN by country, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Groups of four and a shorter last one, as many as the country has; two to eight in all for a country that is not listed."""
    listed = [
        f"(?:{names.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
        for n, names in IBAN_LENGTHS.items()
    ]
    other = f"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}\\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return f"(?:{'|'.join([*listed, other])})"


#: Patterns by kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "iban": _L + _iban_pattern() + _R,
    "ip": r"(?<![\p{L}\p{N}.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?[\p{L}\p{N}])",
    "date": _L + r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})" + _R,
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}[ .-]?\d{2,4}|\+\d{1,3}(?:(?! \d{1,3}\.\d)[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})" + _R,
    "card": _L + r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{5})" + _R,
}
KINDS = tuple(PATTERNS)


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _mac(key: str, message: str) -> str:
    """SQL for HMAC-SHA256 in hex."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (bytes(x ^ pad for x in secret).hex() for pad in (0x36, 0x5C))
    return f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', cast({message} as binary)), 256))), 256)"


def _round(key: str, tweak: str, i: str, x: str) -> str:
    """60 bits of a keyed hash."""
    return f"cast(conv(substr({_mac(key, f"concat({tweak}, ':', {i}, ':', {x})")}, 1, 15), 16, 10) as bigint)"


def feistel(key: str, tweak: str, a: str, b: str, ma: str, mb: str, back: bool = False) -> str:
    """SQL for struct(a, b): the permuted halves, a below ma and b below mb (both below 10^18). back: the inverse."""
    sign, order = ("-", f"sequence({ROUNDS - 1}, 0)") if back else ("+", f"sequence(0, {ROUNDS - 1})")
    even = f"named_struct('a', pmod(s.a {sign} pmod({_round(key, tweak, 'i', 's.b')}, {ma}), {ma}), 'b', s.b)"
    odd = f"named_struct('a', s.a, 'b', pmod(s.b {sign} pmod({_round(key, tweak, 'i', 's.a')}, {mb}), {mb}))"
    return f"aggregate({order}, named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> if(i % 2 = 0, {even}, {odd}))"


def _ten(n: str) -> str:
    return f"cast(concat('1', repeat('0', {n})) as bigint)"


def permuted_digits(key: str, tweak: str, digits: str, back: bool = False) -> str:
    """SQL for a string of digits of the same length (1 to 36), permuted."""
    half = f"length({digits}) div 2"
    left, right = f"concat('0', substr({digits}, 1, cast({half} as int)))", f"substr({digits}, cast({half} as int) + 1)"
    both = feistel(key, f"concat({tweak}, length({digits}))", f"cast({left} as bigint)", f"cast({right} as bigint)", _ten(f"cast({half} as int)"), _ten(f"cast(length({digits}) - {half} as int)"), back)
    pad = "concat(if({h} = 0, '', lpad(cast(z.a as string), {h}, '0')), lpad(cast(z.b as string), length({d}) - {h}, '0'))".format(h=f"cast({half} as int)", d=digits)
    return _let("z", both, pad)


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _refill(template: str, digits: str) -> str:
    """SQL for the template with its digits replaced, in order."""
    return f"aggregate(split({template}, ''), named_struct('t', '', 'i', 1), (s, c) -> if(c rlike '^[0-9]$', named_struct('t', concat(s.t, substr({digits}, s.i, 1)), 'i', s.i + 1), named_struct('t', concat(s.t, c), 'i', s.i))).t"


def _luhn(digits: str) -> str:
    """SQL for the sum that a valid number has divisible by 10."""
    return f"aggregate(reverse(split({digits}, '')), named_struct('t', 0, 'i', 0), (s, c) -> named_struct('t', s.t + if(s.i % 2 = 1, if(cast(c as int) > 4, 2 * cast(c as int) - 9, 2 * cast(c as int)), cast(c as int)), 'i', s.i + 1)).t"


def _mod97(chars: str) -> str:
    """SQL for the number that the characters spell (A = 10), modulo 97."""
    return f"aggregate(split({chars}, ''), 0, (s, c) -> if(c = '', s, if(c rlike '^[0-9]$', (s * 10 + cast(c as int)) % 97, (s * 100 + ascii(c) - 55) % 97)))"


def _card(key: str, m: str, back: bool = False) -> str:
    body = permuted_digits(key, "'card'", "substr(d, 1, length(d) - 1)", back)
    made = _let("e", body, f"concat(e, cast(pmod(10 - {_luhn("concat(e, '0')")} % 10, 10) as string))")
    return _let("d", _digits(m), f"if(length(d) between 13 and 19 and {_luhn('d')} % 10 = 0, {_let('f', made, _refill(m, 'f'))}, null)")


def _iban(key: str, m: str, back: bool = False) -> str:
    plain = f"replace({m}, ' ', '')"
    account = _refill("substr(p, 5)", "g")
    check = f"lpad(cast(98 - {_mod97("concat(h, substr(p, 1, 2), '00')")} as string), 2, '0')"
    made = _let("g", permuted_digits(key, "concat('iban', substr(p, 1, 2))", _digits("substr(p, 5)"), back), _let("h", account, f"concat(substr(p, 1, 2), {check}, h)"))
    # Blanks go back where they were.
    spaced = f"aggregate(split({m}, ''), named_struct('t', '', 'i', 1), (s, c) -> if(c = ' ', named_struct('t', concat(s.t, ' '), 'i', s.i), named_struct('t', concat(s.t, substr(q, s.i, 1)), 'i', s.i + 1))).t"
    valid = f"length(p) between 15 and 34 and {_digits('substr(p, 5)')} != '' and {_mod97('concat(substr(p, 5), substr(p, 1, 4))')} = 1"
    return _let("p", plain, f"if({valid}, {_let('q', made, spaced)}, null)")


def _ip(key: str, m: str, back: bool = False) -> str:
    valid = "forall(o, x -> cast(x as int) <= 255 and (x = '0' or not startswith(x, '0')))"
    both = feistel(key, "'ip'", "cast(o[0] as int) * 256 + cast(o[1] as int)", "cast(o[2] as int) * 256 + cast(o[3] as int)", "65536", "65536", back)
    made = _let("z", both, "concat_ws('.', cast(z.a div 256 as string), cast(z.a % 256 as string), cast(z.b div 256 as string), cast(z.b % 256 as string))")
    return _let("o", f"split({m}, '[.]')", f"if({valid}, {made}, null)")


def _ssn(key: str, m: str, back: bool = False) -> str:
    valid = "w.a between 1 and 899 and w.a != 666 and w.g between 1 and 99 and w.n between 1 and 9999"
    both = feistel(key, "'ssn'", "w.a - 1 - if(w.a > 666, 1, 0)", "(w.g - 1) * 9999 + w.n - 1", "898", "989901", back)
    area = "cast(z.a + 1 + if(z.a + 1 >= 666, 1, 0) as string)"
    made = _let("z", both, f"concat(lpad({area}, 3, '0'), '-', lpad(cast(z.b div 9999 + 1 as string), 2, '0'), '-', lpad(cast(z.b % 9999 + 1 as string), 4, '0'))")
    parts = f"named_struct('a', cast(substr({m}, 1, 3) as int), 'g', cast(substr({m}, 5, 2) as int), 'n', cast(substr({m}, 8, 4) as int))"
    return _let("w", parts, f"if({valid}, {made}, null)")


def _date(key: str, m: str, back: bool = False) -> str:
    shape = f"if({m} like '____-%', 'yyyy-MM-dd', if({m} like '%/%', 'dd/MM/yyyy', 'dd.MM.yyyy'))"
    iso = f"if({m} like '____-%', {m}, concat_ws('-', substr({m}, 7, 4), substr({m}, 4, 2), substr({m}, 1, 2)))"
    days = "datediff(d, date'1950-01-01')"
    both = feistel(key, "'date'", f"pmod({days}, 36525) div 487", f"pmod({days}, 36525) % 487", "75", "487", back)
    moved = f"date_add(date'1950-01-01', cast(floor({days} / 36525) * 36525 + z.a * 487 + z.b as int))"
    made = _let("z", both, f"date_format({moved}, {shape})")
    return _let("d", f"try_cast({iso} as date)", f"if(d is null or floor({days} / 36525) not between -19 and 79, null, {made})")


def _phone(key: str, m: str, back: bool = False) -> str:
    lead = f"regexp_extract({m}, '^(\\\\+[0-9]{{1,3}}(?=[ .(-]))?', 0)"
    rest = f"substr({m}, length(l) + 1)"
    made = _let("g", permuted_digits(key, "'phone'", _digits(rest), back), f"concat(l, {_refill(rest, 'g')})")
    return _let("l", lead, f"if(length({_digits(m)}) between 7 and 15 and {_digits(rest)} != '', {made}, null)")


def _email(key: str, m: str, back: bool = False) -> str:
    return "cast(null as string)" if back else f"concat('u', substr({_mac(key, f"concat('email:', lower({m}))")}, 1, 20), substr({m}, instr({m}, '@')))"


_MADE = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(key: str, m: str, back: bool = False) -> str:
    """SQL for struct(kind, value): of a match of any pattern; null where it fails its check. back: the value of a pseudonym."""
    out = "cast(null as struct<kind:string,value:string>)"
    for kind in reversed(KINDS):
        whole = _quote(f"^(?:{PATTERNS[kind]})$")
        out = f"if({m} rlike {whole}, {_let('v', _MADE[kind](key, m, back), f"if(v is null, null, named_struct('kind', '{kind}', 'value', v))")}, {out})"
    return out


def everything() -> str:
    """One pattern for all kinds. Only the last kind has groups, so its back-references hold."""
    return "|".join(PATTERNS.values())


def restore(docs: DataFrame, key: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The texts that `pseudonymise` was given, but for e-mail addresses, and the number of values of each kind that are back."""
    return pseudonymise(docs, key, text_col, keep, back=True)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", keep: list[str] | None = None, back: bool = False) -> DataFrame:
    """`docs` (or its columns `keep`) with the text's personal data replaced and the number of each kind, n_<kind>; one narrow pass.

    Result columns that `docs` has already are replaced.
    """
    made = [f"n_{k}" for k in KINDS]
    pattern = _quote(everything())
    text = f"`{text_col}`"
    some = F.expr(f"{text} rlike '[0-9@]'")
    found = F.when(some, F.expr(f"transform(regexp_extract_all({text}, {pattern}, 0), m -> named_struct('was', m, 'new', {pseudonym(key, 'm', back)}))"))
    at = "__found"
    while at in docs.columns:
        at += "_"
    rows = docs.withColumn(at, found)
    joined = F.expr(f"array_join(zip_with(split({text}, {pattern}, -1), {at}, (a, b) -> concat(a, coalesce(b.new.value, b.was, ''))), '')")
    any_new = F.expr(f"coalesce(exists({at}, x -> x.new is not null), false)")
    counts = [F.expr(f"coalesce(cast(size(filter({at}, x -> x.new.kind = '{k}')) as bigint), 0L)").alias(f"n_{k}") for k in KINDS]
    order = [c for c in (docs.columns if keep is None else keep) if c not in made]
    columns = [F.when(any_new, joined).otherwise(F.col(text)).alias(c) if c == text_col else F.col(f"`{c}`") for c in order]
    return rows.select(*columns, *[F.when(any_new, c).otherwise(F.lit(0).cast("long")).alias(f"n_{k}") for c, k in zip(counts, KINDS)])
