"""PII: format-preserving pseudonyms by a keyed Feistel permutation, in SQL expressions only.

Addresses, phone, card, account and social security numbers, network addresses, dates and
credentials are found by one pattern and validated (Luhn, mod 97, ranges, calendar). What
is valid is replaced by another value of the same format: its symbols, each with its own
alphabet or range, go through a Feistel network whose round function is SHA-256 of the key,
the kind and the other half, expanded by place and taken modulo each symbol's range. So the map is a permutation
of the format under the key: equal values get equal pseudonyms in every document, different
values different ones, and check digits are made anew. Separators, country codes, mail
domains and the leading digit of cards stay; separators don't enter the permutation, so a
card number keeps its pseudonym however it is spaced.

Nothing but DataFrame functions runs: a document is split at its matches, these are mapped
inside the row and joined again; there is no shuffle. Round states are folded with
``aggregate``, which keeps expressions small.

Fixed formats: dates of 1900 to 2099 (73,049 days, permuted as 17 x 4,297) written
yyyy-mm-dd, mm/dd/yyyy or dd.mm.yyyy; IPv4 octets keep their number of digits; social
security numbers keep to valid areas, groups and serials.

Credentials are the values of ``password``, ``token``, ``secret``, ``api_key`` and the like, in
any case, after ":" or "=" with or without spaces and quotes. A hexadecimal one keeps its case;
two that differ in case only are one value, so an upper-cased copy gets the upper-cased pseudonym.
Credentials and mail names are of any length: each run of ``RUN`` characters is permuted by itself under
its own tweak, so the work is linear in the length and a round's state is small.

Defined cases: a null text stays null, an empty one empty, both without spans; what looks
like a number but fails validation is left; adjacent matches are handled one after another;
repeated rows get equal results; an empty table gives an empty result; a text of any length is
handled in its row, with memory in proportion to it (a few dozen bytes a character of its longest match); other columns are
kept, but a column named as the span column is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinloom.llm.slices import private

ROUNDS = 10
#: Characters of a credential or an address that are permuted together; longer ones are cut into runs.
RUN = 256
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
EPOCH, DAYS_HIGH, DAYS_LOW = "1900-01-01", 17, 4297

#: Words that name a credential, in any case, before ":" or "="; a value may be quoted, and so may the word (JSON).
PASSWORD_WORDS = ("password", "passwd", "pwd")
TOKEN_WORDS = ("token", "secret", "api[_-]?key", "access[_-]?key", "secret[_-]?key", "private[_-]?key")


def _named(words: tuple[str, ...]) -> str:
    """What may stand before a credential's value: bounded and without groups, so that it can be looked behind."""
    any_case = lambda w: "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in w)
    return "|".join(any_case(w) + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?" for w in words)


#: A cheap test of what stands right before a value comes before the long look behind.
_BEFORE = r"(?<=[:=]\s{0,3}[\"']?)"
_TOKEN = r"[0-9A-Za-z_+/=~-]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: kind -> what it looks like; earlier kinds win at the same place.
LOOKS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "password": rf"{_BEFORE}(?<={_named(PASSWORD_WORDS)})[^\s\"']{{6,}}+",
    "token": rf"{_BEFORE}(?<={_named(TOKEN_WORDS)}){_TOKEN}{{16,}}+(?:\.{_TOKEN}++){{0,4}}+",
    "access_key": r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)",
    "phone_plain": r"(?<![\d+])\+\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{13,19})(?!\d)",
    "date": r"(?<![\d.])(?:(?:19|20)\d{2}-\d{2}-\d{2}|\d{2}/\d{2}/(?:19|20)\d{2}|\d{2}\.\d{2}\.(?:19|20)\d{2})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv4": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
}
PATTERN = "|".join(LOOKS.values())
#: What every match has in or right before it: a text without one of these has no match, and is not looked at further.
SIGNS = "[@0-9:=]|AKIA"
#: The end of a text that a credential follows, and more characters than it can have.
CREDENTIAL_NEXT, NEXT_LENGTH = f"(?:{_named(PASSWORD_WORDS + TOKEN_WORDS)})$", 40


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _feistel(key: str, kind: str, values: str, ranges: str, run: str = "0") -> str:
    """SQL for the permuted array of ``values`` (bigint), each below its entry of ``ranges``.

    A round hashes the other half once; each symbol's number comes from that digest and its place.
    """
    half = f"(size({ranges}) div 2)"
    rest = f"array_join(filter(acc, (y, t) -> (t < {half}) != (i % 2 = 0)), ',')"
    seed = f"sha2(concat({_text(key + '|' + kind + '|')}, {run}, '|', i, '|', array_join({ranges}, ','), '|', {rest}), 256)"
    word = "conv(substr(sha2(concat(seed, '|', j), 256), 1, 12), 16, 10)"
    turn = f"transform(acc, (x, j) -> if((j < {half}) = (i % 2 = 0), pmod(x + cast({word} as bigint), {ranges}[j]), x))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {values}, (acc, i) -> {_let('seed', seed, turn)})"


def _by_class(c: str) -> str:
    return f"case when {c} between '0' and '9' then '{DIGITS}' when {c} between 'a' and 'z' then '{LOWER}' when {c} between 'A' and 'Z' then '{UPPER}' else '' end"


def _symbols(key: str, kind: str, m: str, alphabet: str, run: str = "0") -> str:
    """SQL for ``m`` with its symbols permuted; ``alphabet`` is SQL of (k: position, c: character), '' where it stays."""
    chars = f"filter(split({m}, ''), x -> x != '')"
    places = f"transform({chars}, (c, z) -> {_let('k', 'z + 1', f'named_struct({_text("k")}, k, {_text("c")}, c, {_text("a")}, {alphabet})')})"
    values = "transform(own, p -> cast(instr(p.a, p.c) - 1 as bigint))"
    ranges = "transform(own, p -> cast(length(p.a) as bigint))"
    new = "transform(own, (p, t) -> named_struct('k', p.k, 'c', substr(p.a, cast(os[t] as int) + 1, 1)))"
    stay = "transform(filter(ps, p -> p.a = ''), p -> named_struct('k', p.k, 'c', p.c))"
    back = f"array_join(transform(array_sort(concat({stay}, {new})), p -> p.c), '')"
    mapped = _let("rs", ranges, _let("os", _feistel(key, kind, values, "rs", run), back))
    return _let("ps", places, _let("own", "filter(ps, p -> p.a != '')", mapped))


def _in_runs(key: str, kind: str, m: str, alphabet: str) -> str:
    """``_symbols`` for a string of any length: runs of RUN characters, each under its own tweak, so work is linear in it."""
    pieces = f"regexp_extract_all({m}, '(?s).{{1,{RUN}}}', 0)"
    return f"array_join(transform({pieces}, (q, run) -> {_symbols(key, kind, 'q', alphabet, 'run')}), '')"


def _numbers(key: str, kind: str, values: str, ranges: str, body: str) -> str:
    """SQL of ``body`` over ``os``, the permuted numbers."""
    return _let("rs", ranges, _let("os", _feistel(key, kind, values, "rs"), body))


def _luhn_digit(m: str) -> str:
    """SQL for the check digit of a card number whose last digit is to be made."""
    digits = f"reverse(substr(regexp_replace({m}, '[^0-9]', ''), 1, length(regexp_replace({m}, '[^0-9]', '')) - 1))"
    doubled = "cast(substr(ds, k, 1) as int) * if(k % 2 = 1, 2, 1)"
    total = f"aggregate(sequence(1, length(ds)), 0, (acc, k) -> acc + {_let('d', doubled, 'if(d > 9, d - 9, d)')})"
    return _let("ds", digits, f"cast(pmod(-({total}), 10) as string)")


def _mod97(m: str) -> str:
    """SQL for an account number's remainder by 97, its first four characters moved to the end."""
    moved = f"concat(substr(regexp_replace({m}, ' ', ''), 5), substr(regexp_replace({m}, ' ', ''), 1, 4))"
    step = "if(c between '0' and '9', (acc * 10 + cast(c as int)) % 97, (acc * 100 + ascii(c) - 55) % 97)"
    return _let("ds", moved, f"aggregate(sequence(1, length(ds)), 0, (acc, k) -> {_let('c', 'substr(ds, k, 1)', step)})")


def _mapped(key: str, kind: str, m: str) -> str:
    """SQL for the pseudonym of a match of a kind; null where it isn't valid."""
    after = f"length(regexp_replace(substr({m}, k + 1), '[^0-9]', ''))"
    if kind == "email":
        local, domain = f"substring_index({m}, '@', 1)", f"substr({m}, instr({m}, '@'))"
        return f"concat({_in_runs(key, kind, local, _by_class('c'))}, {domain})"
    if kind in ("password", "token"):
        alphabet = f"case when {m} rlike '^[0-9a-f]+$' then {_text(HEX)} when {m} rlike '^[0-9A-F]+$' then {_text(HEX.upper())} end"
        return _let("hx", alphabet, f"if(hx is null, {_in_runs(key, kind, m, _by_class('c'))}, {_in_runs(key, kind + '-hex', m, 'hx')})")
    if kind == "access_key":
        return _symbols(key, kind, m, f"if(k <= 4, '', {_by_class('c')})")
    if kind == "iban":
        made = _symbols(key, kind, m, f"if(k <= 4, '', {_by_class('c')})")
        zeroed = "concat(substr(w, 1, 2), '00', substr(w, 5))"
        checked = _let("w", made, f"concat(substr(w, 1, 2), lpad(cast(98 - {_mod97(zeroed)} as string), 2, '0'), substr(w, 5))")
        return f"if({_mod97(m)} = 1, {checked}, null)"
    if kind.startswith("phone"):
        lead = f"c >= '2' and {after} in (6, 9)"
        return _symbols(key, "phone", m, f"case when not c between '0' and '9' or {after} > 9 then '' when {lead} then '23456789' else '{DIGITS}' end")
    if kind == "card":
        made = _symbols(key, kind, m, f"if(k = 1 or not c between '0' and '9' or k = length({m}), '', '{DIGITS}')")
        whole = _let("w", made, f"concat(substr(w, 1, length(w) - 1), {_luhn_digit('w')})")
        return f"if(luhn_check(regexp_replace({m}, '[^0-9]', '')), {whole}, null)"
    if kind == "ssn":
        fields = f"transform(split({m}, '-'), f -> cast(f as bigint))"
        valid = "fs[0] between 1 and 899 and fs[0] != 666 and fs[1] > 0 and fs[2] > 0"
        values = "array(if(fs[0] > 666, fs[0] - 2, fs[0] - 1), fs[1] - 1, fs[2] - 1)"
        body = "concat(lpad(cast(if(os[0] >= 665, os[0] + 2, os[0] + 1) as string), 3, '0'), '-', lpad(cast(os[1] + 1 as string), 2, '0'), '-', lpad(cast(os[2] + 1 as string), 4, '0'))"
        return _let("fs", fields, f"if({valid}, {_numbers(key, kind, values, 'array(898L, 99L, 9999L)', body)}, null)")
    if kind == "ipv4":
        parts = f"split({m}, '[.]')"
        least = "case length(f) when 1 then 0L when 2 then 10L else 100L end"
        ranges = f"transform({parts}, f -> case length(f) when 1 then 10L when 2 then 90L else 156L end)"
        values = f"transform({parts}, f -> cast(f as bigint) - {least})"
        body = f"array_join(transform({parts}, (f, t) -> cast(os[t] + {least} as string)), '.')"
        return _numbers(key, kind, values, ranges, body)
    if kind == "date":
        iso = f"case when {m} like '%-%' then {m} when {m} like '%/%' then concat_ws('-', substr({m}, 7), substr({m}, 1, 2), substr({m}, 4, 2)) else concat_ws('-', substr({m}, 7), substr({m}, 4, 2), substr({m}, 1, 2)) end"
        values = f"array(cast(n div {DAYS_LOW} as bigint), cast(n % {DAYS_LOW} as bigint))"
        day = f"date_add(date'{EPOCH}', cast(os[0] * {DAYS_LOW} + os[1] as int))"
        written = f"case when {m} like '%-%' then date_format({day}, 'yyyy-MM-dd') when {m} like '%/%' then date_format({day}, 'MM/dd/yyyy') else date_format({day}, 'dd.MM.yyyy') end"
        moved = _numbers(key, kind, values, f"array({DAYS_HIGH}L, {DAYS_LOW}L)", written)
        return _let("n", f"datediff(try_to_date({iso}, 'yyyy-MM-dd'), date'{EPOCH}')", f"if(n is null, null, {moved})")
    raise ValueError(kind)


def _whole(look: str) -> str:
    """A look as a test of a whole match: what stands around it is no longer there."""
    import re

    return "^(?:" + re.sub(r"^\(\?<[!=](?:\[[^\]]*\]|[^)\[])*\)|\(\?[!=](?:\[[^\]]*\]|[^)\[])*\)$", "", look) + ")$"


def mapped_match(key: str, m: str = "m", before: str = "''") -> str:
    """SQL for a struct (kind, pseudonym) of a match ``m``; the pseudonym is null where it isn't valid.

    What is named as a credential in the text ``before`` is one even if it looks like an invalid number.
    """
    order = ["email", "access_key", "iban", "phone", "phone_plain", "card", "date", "ssn", "ipv4"]
    tests = " ".join(f"when {m} rlike {_text(_whole(LOOKS[k]))} then '{'phone' if k == 'phone_plain' else k}'" for k in order)
    kind = f"case {tests} else 'credential' end"
    maps = " ".join(f"when '{k}' then {_mapped(key, k, m)}" for k in order if k != "phone_plain")
    named = f"kd = 'credential' or right({before}, {NEXT_LENGTH}) rlike {_text(CREDENTIAL_NEXT)}"
    credential = f"named_struct('kind', 'credential', 'new', {_mapped(key, 'token', m)})"
    return _let("kd", kind, _let("nw", f"case kd {maps} end", f"if(nw is null and ({named}), {credential}, named_struct('kind', kd, 'new', nw))"))


def pseudonymize(df: DataFrame, key: str, text: str = "text", spans: str = "pii") -> DataFrame:
    """``df`` with pseudonyms in its text and an array of what was replaced.

    ``spans`` holds (kind, start, length) in code points of the text, from 0.
    """
    pattern = _text(PATTERN)
    own = private(df.select("*", F.lit(0).alias(spans)), "ms", "new", "between")
    ms, new, between = own["ms"], own["new"], own["between"]
    out = df.withColumn(ms, F.expr(f"if({text} rlike {_text(SIGNS)}, regexp_extract_all({text}, {pattern}, 0), array())"))
    out = out.withColumn(between, F.expr(f"if(size({ms}) > 0, split({text}, {pattern}, -1), null)"))
    out = out.withColumn(new, F.expr(f"if(size({ms}) > 0, transform({ms}, (m, at) -> {mapped_match(key, 'm', f'{between}[at]')}), null)"))
    joined = f"concat(array_join(transform({ms}, (m, i) -> concat({between}[i], coalesce({new}[i].new, m))), ''), {between}[size({ms})])"
    step = f"named_struct('at', acc.at + length({between}[i]) + length({ms}[i]), 'out', if({new}[i].new is null, acc.out, concat(acc.out, array(named_struct('kind', {new}[i].kind, 'start', acc.at + length({between}[i]), 'length', length({ms}[i]))))))"
    empty = "cast(array() as array<struct<kind: string, start: int, length: int>>)"
    listed = f"aggregate(sequence(0, size({ms}) - 1), named_struct('at', 0, 'out', {empty}), (acc, i) -> {step}, acc -> acc.out)"
    out = out.withColumn(spans, F.expr(f"if(size({ms}) > 0, {listed}, {empty})"))
    return out.withColumn(text, F.expr(f"if(size({ms}) > 0, {joined}, {text})")).drop(ms, new, between)
