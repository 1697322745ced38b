"""Text around pictures as SQL expressions: slugs, sizes, times, paths, fingerprints and keys. Arguments are SQL."""

from __future__ import annotations

#: Units; fixed values.
BYTE_UNITS, BINARY_UNITS = ("B", "KB", "MB", "GB"), ("B", "KiB", "MiB", "GiB", "TiB")
LOW32 = "4294967295L"


def quoted(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fixed(value: str, digits: int) -> str:
    """A number that is not negative with so many decimals, halves upwards."""
    scaled = f"cast(floor({value} * {10.0**digits!r}D + 0.5D) as bigint)"
    if digits == 0:
        return f"cast({scaled} as string)"
    return f"concat({scaled} div {10**digits}, '.', lpad(cast({scaled} % {10**digits} as string), {digits}, '0'))"


def slug(name: str) -> str:
    """Lower-case letters and digits with single hyphens between; ``workflow`` if nothing is left."""
    bare = f"regexp_replace(regexp_replace(lower(trim({name})), '[^a-z0-9]+', '-'), '^-|-$', '')"
    return f"if({bare} = '', 'workflow', {bare})"


def file_size(n: str) -> str:
    """B below 1024, then KB to GB with two decimals below 10 and one from there on."""
    number = lambda d: f"if({n} / {float(d)!r}D >= 10, {fixed(f'({n} / {float(d)!r}D)', 1)}, {fixed(f'({n} / {float(d)!r}D)', 2)})"
    k, m, g = 1 << 10, 1 << 20, 1 << 30
    return f"case when {n} < {k} then concat({n}, ' B') when {n} < {m} then concat({number(k)}, ' KB') when {n} < {g} then concat({number(m)}, ' MB') else concat({number(g)}, ' GB') end"


def model_size(n: str) -> str:
    """Binary units, one decimal below 10 of them."""
    parts = [f"when {n} is null or {n} <= 0 then 'Size unavailable'", f"when {n} < 1024 then concat({fixed(n, 0)}, ' B')"]
    for k, unit in enumerate(BINARY_UNITS[1:], 1):
        value = f"({n} / {float(1 << 10 * k)!r}D)"
        shown = f"concat(if({value} >= 10, {fixed(value, 0)}, {fixed(value, 1)}), ' {unit}')"
        parts.append(f"else {shown}" if k == len(BINARY_UNITS) - 1 else f"when {n} < {1 << 10 * (k + 1)} then {shown}")
    return f"case {' '.join(parts)} end"


def memory(mb: str) -> str:
    gb = f"({mb} / 1024D)"
    return f"case when {mb} <= 0 then 'Not specified' when {mb} < 1024 then concat({mb}, ' MB estimated') when {mb} % 1024 = 0 then concat({mb} div 1024, ' GB estimated') else concat({fixed(gb, 1)}, ' GB estimated') end"


def duration(ns: str) -> str:
    """Nanoseconds as ns, µs or ms."""
    return f"case when {ns} <= 0 then '<1 ns' when {ns} < 1000 then concat({fixed(ns, 0)}, ' ns') when {ns} < 1000000 then concat({fixed(f'({ns} / 1000D)', 2)}, ' µs') else concat({fixed(f'({ns} / 1000000D)', 2)}, ' ms') end"


def date_only(text: str) -> str:
    """The day of an ISO time in UTC."""
    return f"coalesce(date_format(try_to_timestamp({text}), 'yyyy-MM-dd'), 'Modified date unavailable')"


def valid_time(text: str) -> str:
    """1 to 64 characters that are an ISO time."""
    return f"coalesce(char_length({text}) between 1 and 64 and try_to_timestamp({text}) is not null, false)"


def source_path(path: str) -> str:
    """Slashes forward and single, lower case, without . and with .. resolved; an absolute path stays within its root."""
    clean = f"lower(regexp_replace(replace(trim({path}), '\\\\', '/'), '/{{2,}}', '/'))"
    step = (
        "aggregate(filter(split(p, '/'), x -> x != '' and x != '.'), cast(array() as array<string>), (s, x) -> "
        "case when x != '..' then concat(s, array(x)) when size(s) > 0 and s[size(s) - 1] != '..' then slice(s, 1, size(s) - 1) "
        "when p rlike '^(/|[a-z]:/)' then s else concat(s, array(x)) end)"
    )
    return f"transform(array({clean}), p -> concat(if(startswith(p, '/'), '/', ''), array_join({step}, '/')))[0]"


def code_units(text: str) -> str:
    """The UTF-16 code units of a text, as an array of numbers."""
    hexed = f"hex(encode({text}, 'UTF-16BE'))"
    return f"transform(filter(sequence(0, length({hexed}) div 4), i -> i * 4 < length({hexed})), i -> cast(conv(substring({hexed}, i * 4 + 1, 4), 16, 10) as bigint))"


def _times32(x: str, factor: int) -> str:
    """A product's low 32 bits, by halves, so that nothing overflows."""
    return f"(((({x} div 65536) * {factor}L & 65535L) * 65536L + ({x} % 65536) * {factor}L) & {LOW32})"


def pair_fingerprint(text: str) -> str:
    """Length and two 32-bit multiplicative hashes of a text's code units, in hexadecimal."""
    one, two = 0x01000193, 0x85EBCA6B
    fold = f"aggregate({code_units(text)}, named_struct('a', {0x811C9DC5}L, 'b', {0x9E3779B9}L), (s, c) -> named_struct('a', {_times32('(s.a ^ c)', one)}, 'b', {_times32('(s.b ^ c)', two)}), s -> concat(lpad(lower(hex(s.a)), 8, '0'), lpad(lower(hex(s.b)), 8, '0')))"
    return f"concat(size({code_units(text)}), ':', {fold})"


def document_key(path: str, width: str, height: str) -> str:
    """Size and FNV-1a-64 of the normalised path and the size, two bytes (low, high) for each code unit."""
    value = f"concat({source_path(path)}, '\\0', {width}, 'x', {height})"
    low = f"((s.l ^ c) * {0x1B3}L)"
    # the prime is 2**40 + 0x1B3, so the upper half also gets the lower one, moved by eight bits
    step = f"transform(array({low}), t -> named_struct('h', (s.h * {0x1B3}L + (t div 4294967296L) + ((s.l ^ c) & 16777215L) * 256L) & {LOW32}, 'l', t & {LOW32}))[0]"
    octets = f"flatten(transform({code_units(value)}, u -> array(u & 255L, u div 256)))"
    return f"concat({width}, 'x', {height}, '-', aggregate({octets}, named_struct('h', {0xCBF29CE4}L, 'l', {0x84222325}L), (s, c) -> {step}, s -> concat(lpad(lower(hex(s.h)), 8, '0'), lpad(lower(hex(s.l)), 8, '0'))))"


def loopback(endpoint: str) -> str:
    """Whether an address is plain http to this machine, without a user, path, query or fragment."""
    return f"coalesce(trim({endpoint}) rlike '^(?i:http)://(?i:127[.]0[.]0[.]1|localhost|\\\\[::1\\\\])(:([0-9]{{1,4}}|[1-5][0-9]{{4}}|6[0-4][0-9]{{3}}|65[0-4][0-9]{{2}}|655[0-2][0-9]|6553[0-5]))?/?$', false)"
