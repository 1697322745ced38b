"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Only built-in functions run. Spark's regular expressions give the matches and the pieces between them, not their
places; a fold over both adds the lengths up to code-point offsets. Patterns are written so that a scan is linear
in the text (possessive runs, entered only at their beginning), and each runs only on texts that can match.

Kinds, in their order: the base kinds email, ip, card and phone, then iban (mod 97) and tel, a national phone
number without a country code, and secret, a key or token written as a long run of hexadecimal digits. Base spans always
stay. The others are scored: SCORES gives what the pattern, a checksum (for a secret: the variety of its digits) and a
context word within WINDOW code points before or behind the span are worth, and a span is kept from KEEP on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "tel", "secret")
#: Matches to a block of a text's fold; within a block places are added up one by one, so work grows with it per match.
FOLD = 64
#: Code points to a chunk of a text that is put together anew.
CHUNK = 4096
#: Characters of an IBAN by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
#: Java patterns with the matches of the base patterns. An email is only tried where a run of its local
#: characters begins or the last match ended; the same for runs of digits. An IBAN ends where its country's length says,
#: whatever stands behind a blank; for other codes and lengths it is a whole run, up to one that ends by its length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]*[0-9](?<=[\x20().0-9-][0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{_IBAN}))?[A-Z0-9]){{11,30}}+(?![A-Za-z0-9]))",
    "tel": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}+(?![0-9A-Za-z])",
}
#: What a text must contain for a kind to be looked for.
GATES = {
    "email": "instr({t}, '@') > 0",
    "ip": r"{t} rlike '[0-9]\\.[0-9]'",
    "card": "{t} rlike '[0-9][0-9 -]{{10}}'",
    "phone": r"{t} rlike '\\+[0-9]'",
    "iban": "{t} rlike '[A-Z]{{2}}[0-9]{{2}}'",
    "tel": "{t} rlike '[0-9]{{3}}[-. ][0-9]{{4}}'",
    "secret": "{t} rlike '[0-9A-Fa-f]{{32}}'",
}
#: Tests of a match z.m. dgt is the match without anything but digits.
TESTS = {
    "email": "true",
    "ip": "forall(split(z.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(right(concat('00', p), 3) as int) <= 255)",
    "card": "length({dgt}) between 12 and 19 and {luhn} % 10 = 0",
    "phone": "length({dgt}) between 9 and 15",
    "iban": "{mod97} = 1",
    "tel": "true",
    "secret": "size(array_distinct(split(lower(z.m), ''))) >= 9",
}
_DIGITS = "regexp_replace(z.m, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + element_at(if(i % 2 = 1, array(0,1,2,3,4,5,6,7,8,9), "
    f"array(0,2,4,6,8,1,3,5,7,9)), cast(substring({_DIGITS}, -i, 1) as int) + 1))"
)
#: Country and check digits go behind, letters count 10 to 35, the remainder is folded digit by digit.
_MOD97 = (
    "aggregate(filter(split(concat(substring(replace(z.m, ' ', ''), 5), left(replace(z.m, ' ', ''), 4)), ''), c -> c != ''), 0, "
    "(s, c) -> if(c between '0' and '9', (s * 10 + (ascii(c) - 48)) % 97, (s * 100 + (ascii(c) - 55)) % 97))"
)
WINDOW, KEEP = 40, 0.7
#: Worth of pattern, checksum and context word.
SCORES = {"email": (0.9, 0.0, 0.1), "ip": (0.7, 0.0, 0.2), "card": (0.4, 0.5, 0.1), "phone": (0.7, 0.0, 0.2), "iban": (0.4, 0.5, 0.1), "tel": (0.5, 0.0, 0.4), "secret": (0.3, 0.2, 0.4)}
#: Words nearby that speak for a kind, whole words in lower case or their plural; fixed values.
CONTEXT = {
    "email": "mail|e-mail|email|contact|write|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|mastercard|credit|karte|kreditkarte|tarjeta|carte",
    "phone": "phone|telephone|call|tel|fax|mobile|telefon|telefono|teléfono|llame|appel|appelez",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "tel": "phone|telephone|call|tel|fax|mobile|telefon|telefono|teléfono|llame|appel|appelez",
    "secret": "token|secret|key|apikey|password|passwd|credential|bearer|auth",
}


def _spans(kind: str, text: str):
    """array<struct<start, rank, stop, kind, score>> of the confirmed matches of a kind."""
    pattern = PATTERNS[kind].replace("\\", "\\\\")
    test = TESTS[kind].format(dgt=_DIGITS, luhn=_LUHN, mod97=_MOD97)
    a, b, c = SCORES[kind]
    word = f"(?<![\\\\p{{L}}\\\\p{{N}}])({CONTEXT[kind]})s?(?![\\\\p{{L}}\\\\p{{N}}])"
    # what stands beside a match, over one neighbouring match at most; a word that an end of the window cuts is no whole one
    before = f"right(concat(coalesce(get(gaps, i - 1), ''), coalesce(get(found, i - 1), ''), gaps[i]), {WINDOW + 1})"
    behind = f"left(concat(gaps[i + 1], coalesce(get(found, i + 1), ''), coalesce(get(gaps, i + 2), '')), {WINDOW + 1})"
    cut_off = f"if(char_length({before}) > {WINDOW}, regexp_replace({before}, '^.[\\\\p{{L}}\\\\p{{N}}]*', ''), {before})"
    cut_end = f"if(char_length({behind}) > {WINDOW}, regexp_replace({behind}, '[\\\\p{{L}}\\\\p{{N}}]*+.\\\\z', ''), {behind})"
    near = f"lower(concat({cut_off}, ' ', {cut_end})) rlike '{word}'"
    span = (
        f"named_struct('start', cast(z.at as bigint), 'rank', {KINDS.index(kind)}, 'stop', cast(z.at + char_length(z.m) as bigint), 'kind', '{kind}', "
        f"'score', cast({a + b} + if({near}, {c}, 0.0) as double))"
    )
    none = "cast(array() as array<struct<start: bigint, rank: int, stop: bigint, kind: string, score: double>>)"
    # a lambda over one element binds a match and its place; a fold's state is code points so far, and the spans
    one = f"transform(array(named_struct('m', found[i], 'at', s.at + char_length(gaps[i]))), z -> if({test}, {span}, null))"
    block = (
        f"aggregate(sequence(b.i, least(b.i + {FOLD}, size(found)) - 1), named_struct('at', b.at, 'out', {none}), (s, i) -> named_struct("
        f"'at', s.at + char_length(gaps[i]) + char_length(found[i]), "
        f"'out', concat(s.out, filter({one}, x -> x is not null))), s -> s.out)"
    )
    # where blocks of matches begin: lists are only ever lengthened within a block, or by a row for each block
    size_ = f"aggregate(sequence(k, least(k + {FOLD}, size(found)) - 1), 0, (n, j) -> n + char_length(gaps[j]) + char_length(found[j]))"
    blocks = (
        f"aggregate(sequence(0, size(found) - 1, {FOLD}), named_struct('at', 0, 'out', cast(array() as array<struct<i: int, at: int>>)), "
        f"(t, k) -> named_struct('at', t.at + {size_}, 'out', concat(t.out, array(named_struct('i', k, 'at', t.at)))), t -> t.out)"
    )
    fold = f"flatten(transform({blocks}, b -> {block}))"
    pair = f"named_struct('found', regexp_extract_all({text}, '{pattern}', 0), 'gaps', split({text}, '{pattern}', -1))"
    bound = fold.replace("found", "p.found").replace("gaps", "p.gaps")
    return f"if({GATES[kind].format(t=text)}, flatten(transform(array({pair}), p -> if(size(p.found) = 0, {none}, {bound}))), {none})"


def _joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """docs with ``out_col``: array of (start, rank, stop, kind, score), by start and then kind, offsets in code points.

    Within a kind spans are leftmost and do not overlap; different kinds may. Scores are between 0 and 1, and higher with a
    context word. A null or empty text has none, and a text is searched whole, however long. Repeated rows have the same
    spans. A column of that name in the input is replaced; all others stay. An empty table gives an empty result.
    """
    out = docs.drop(out_col).withColumn("__pl_text", text_or_empty(text_col))
    found = {f"__pl_{k}": F.expr(_spans(k, "__pl_text")) for k in KINDS}
    kept = ", ".join(f"__pl_{k}" if k in BASE_KINDS else f"filter(__pl_{k}, x -> x.score >= {KEEP})" for k in KINDS)
    return out.withColumns(found).withColumn(out_col, F.expr(f"array_sort(concat({kept}))")).drop("__pl_text", *found)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs whose texts have [KIND] in place of each found span; overlapping spans go as one, named by the first.

    A null text stays null, everything else stays as it is: repeated rows, other columns, and texts without spans. An empty
    table gives an empty result. Work is linear in the text and its spans, as pieces are taken from chunks of it.
    """
    found = find_pii(docs, text_col, "__pl_pii")
    part = f"substring(c[k], cast(greatest(g.a - k * {CHUNK}, 0) + 1 as int), cast(least(g.b - k * {CHUNK}, {CHUNK}) - greatest(g.a - k * {CHUNK}, 0) as int))"
    piece = f"if(g.b <= g.a, '', array_join(transform(sequence(cast(g.a div {CHUNK} as int), cast((g.b - 1) div {CHUNK} as int)), k -> {part}), ''))"
    # where blocks of spans begin, and how far the spans before them reach
    none = "cast(array() as array<struct<i: int, at: bigint>>)"
    reach = f"greatest(t.at, array_max(transform(slice(__pl_pii, k + 1, {FOLD}), x -> x.stop)))"
    blocks = (
        f"aggregate(sequence(0, size(__pl_pii) - 1, {FOLD}), named_struct('at', 0L, 'out', {none}), (t, k) -> named_struct('at', {reach}, "
        "'out', concat(t.out, array(named_struct('i', k, 'at', t.at)))), t -> t.out)"
    )
    # the stretches that stay, each with the label behind it
    empty = "cast(array() as array<struct<a: bigint, b: bigint, kind: string>>)"
    stretches = (
        f"flatten(transform({blocks}, b -> aggregate(slice(__pl_pii, b.i + 1, {FOLD}), named_struct('at', b.at, 'out', {empty}), (s, x) -> named_struct("
        "'at', greatest(s.at, x.stop), 'out', if(x.start < s.at, s.out, concat(s.out, array(named_struct('a', s.at, 'b', x.start, 'kind', x.kind))))), s -> s.out)))"
    )
    last = "named_struct('a', array_max(transform(__pl_pii, x -> x.stop)), 'b', cast(char_length(__pl_text) as bigint), 'kind', '')"
    body = f"array_join(transform(concat({stretches}, array({last})), g -> concat({piece}, if(g.kind = '', '', concat('[', upper(g.kind), ']')))), '')"
    chunks = f"regexp_extract_all(__pl_text, '(?s).{{1,{CHUNK}}}', 0)"
    bound = body.replace("c[k]", "p.c[k]")
    given = found.withColumn("__pl_text", F.col(text_col))
    new = F.expr(f"transform(array(named_struct('c', {chunks})), p -> {bound})[0]")
    return given.withColumn(text_col, F.when(F.size("__pl_pii") > 0, new).otherwise(F.col("__pl_text"))).select(*docs.columns)


def op5_pii_spans(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of the spans of every document."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = "filter(pii, x -> x.rank < 4)"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.expr(_joined(base)).cast("binary"), 256).alias("base_sha256"),
        F.expr(_joined("pii")).alias("spans"),
        F.expr("transform(pii, x -> round(x.score, 2))").alias("scores"),
    )
