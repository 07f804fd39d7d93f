"""Scalar functions as columns: parsing, encoding, versions, JSON, dates, names. What would throw gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def ascii_only(s: Column) -> Column:
    return s.rlike(r"^[\x00-\x7F]*$")


def char_at(s: Column, i: Column) -> Column:
    """The character at a place from 0; null past the end."""
    return F.when((i >= 0) & (i < F.length(s)), F.substr(s, i + 1, F.lit(1)))


def code_at(s: Column, i: Column) -> Column:
    return F.ascii(char_at(s, i))


def skip_space(s: Column, i: Column) -> Column:
    """The place of the first character from i on that isn't white space."""
    rest = F.substr(s, i + 1, F.length(s))
    return i + F.length(rest) - F.length(F.regexp_replace(rest, r"^[ \t\n\r]+", ""))


def signed_integer(s: Column) -> Column:
    """An optional minus and digits, nothing else; -0 is 0."""
    return F.when(s.rlike(r"^-?[0-9]+$"), s.try_cast("long"))


def int_list(s: Column) -> Column:
    """[1, -2, 3] as an array; null where the grammar doesn't hold."""
    ok = s.rlike(r"^\s*\[\s*(-?[0-9]+(\s*,\s*-?[0-9]+)*)?\s*\]\s*$")
    return F.when(ok, F.transform(F.regexp_extract_all(s, F.lit(r"-?[0-9]+"), 0), lambda x: x.try_cast("long")))


def base64url(s: Column) -> Column:
    return F.rtrim(F.translate(F.base64(s.cast("binary")), "+/", "-_"), F.lit("="))


def base32(s: Column) -> Column:
    """RFC 4648 with padding: bits of the hex digits in fives."""
    hexed = F.hex(s.cast("binary"))
    bits = F.array_join(F.transform(F.filter(F.split(hexed, ""), lambda x: x != ""), lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")
    n = F.ceil(F.length(bits) / 5).cast("int")
    digit = lambda i: F.substr(F.lit(BASE32), F.conv(F.rpad(F.substr(bits, i * 5 + 1, F.lit(5)), 5, "0"), 2, 10).cast("int") + 1, F.lit(1))
    body = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), digit), "")).otherwise("")
    return F.rpad(body, F.ceil(n / 8).cast("int") * 8, F.lit("="))


def semver(s: Column) -> Column:
    """[major, minor, patch]; null where s isn't three numbers with dots."""
    ok = s.rlike(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$")
    return F.when(ok, F.transform(F.split(s, r"\."), lambda x: x.try_cast("long")))


def semver_coerced(s: Column) -> Column:
    """The first one to three numbers of s, a v in front allowed, missing parts 0."""
    m = lambda g: F.regexp_extract(s, r"(?:^|[^0-9])v?(\d{1,16})(?:\.(\d{1,16}))?(?:\.(\d{1,16}))?", g)
    part = lambda g: F.coalesce(F.nullif(m(g), F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    return F.when(m(1) != "", F.array(part(1), part(2), part(3)))


def semver_satisfies(version: Column, rule: str) -> Column:
    """Comparators (>= <= > < =, ^ ~ *) joined by spaces (and) and || (or); null for a bad version."""
    v = semver(version)

    def one(c: str) -> Column:
        if c in ("*", ""):
            return F.lit(True)
        op = next((o for o in (">=", "<=", ">", "<", "=", "^", "~") if c.startswith(o)), "")
        nums = [int(x) for x in c[len(op) :].split(".")]
        nums += [0] * (3 - len(nums))
        lit = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        if op == "^":
            k = next((i for i, x in enumerate(nums) if x), 2)
            return (v >= lit(nums)) & (v < lit([*nums[:k], nums[k] + 1, *[0] * (2 - k)]))
        if op == "~":
            return (v >= lit(nums)) & (v < lit([nums[0], nums[1] + 1, 0]))
        w = lit(nums)
        return {">=": v >= w, "<=": v <= w, ">": v > w, "<": v < w}.get(op, v == w)

    out = None
    for part in rule.split("||"):
        both = None
        for c in part.split() or ["*"]:
            both = one(c) if both is None else both & one(c)
        out = both if out is None else out | both
    return F.when(v.isNotNull(), out)


def pointer_path(pointer: str) -> str | None:
    """A JSON pointer as a path expression; null for a bad pointer. Array places are digits without leading zeros."""
    if pointer == "":
        return "$"
    if not pointer.startswith("/"):
        return None
    out = "$"
    for raw in pointer[1:].split("/"):
        key = raw.replace("~1", "/").replace("~0", "~")
        if key.isdigit() and (key == "0" or key[0] != "0"):
            out += f"[{key}]"
        else:
            out += "['" + key.replace("'", "\\'") + "']"
    return out


def json_pointer(doc: Column, pointer: str) -> Column:
    path = pointer_path(pointer)
    return F.lit(None).cast("string") if path is None else F.get_json_object(doc, path)


def json_leaf_sum(doc: Column) -> Column:
    """Sum of all numeric leaves: numbers outside of strings."""
    bare = F.regexp_replace(doc, r'"(?:[^"\\]|\\.)*"', '""')
    found = F.regexp_extract_all(bare, F.lit(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"), 0)
    return F.aggregate(found, F.lit(0.0), lambda s, x: s + x.cast("double"))


def csv_row(s: Column, fields: int) -> Column:
    """The fields of one RFC 4180 line as an array of strings."""
    names = [f"f{i}" for i in range(fields)]
    row = F.from_csv(s, ", ".join(f"{n} string" for n in names), {"quote": '"', "escape": '"', "emptyValue": ""})
    return F.array(*[row.getField(n) for n in names])


def camel(s: Column) -> Column:
    parts = F.split(s, "-")
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20)))
    return F.concat(F.get(parts, 0), F.array_join(rest, ""))


def snake(s: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s-]+", "_"))


def pascal(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, r"[_\s-]+"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")


def digit_sum(s: Column) -> Column:
    return F.aggregate(F.regexp_extract_all(s, F.lit("[0-9]"), 0), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def coordinate(s: Column) -> Column:
    """(x,y) as two doubles."""
    m = lambda g: F.regexp_extract(s, r"^\(\s*(-?[0-9]+(?:\.[0-9]+)?)\s*,\s*(-?[0-9]+(?:\.[0-9]+)?)\s*\)$", g)
    return F.when(m(1) != "", F.array(m(1).try_cast("double"), m(2).try_cast("double")))


def uuid4_valid(s: Column) -> Column:
    return s.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def email_valid(s: Column) -> Column:
    local = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
    label = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
    return s.rlike(rf"^{local}@{label}(?:\.{label})+$") & (F.length(s) <= 254) & (F.instr(s, "@") <= 65)


def rfc3339(s: Column) -> Column:
    """Milliseconds since the epoch; null where s isn't a date, time and offset."""
    ok = s.rlike(r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    return F.when(ok, F.unix_millis(F.try_to_timestamp(s)))


def first_sentence(s: Column) -> Column:
    return F.get(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), r"\. "), 0)


def shortened(s: Column, most: int = 200) -> Column:
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most - 3)), F.lit("..."))).otherwise(s)


def bounds_message(s: Column, least: int, most: int) -> Column:
    return F.when(F.length(s) < least, f"shorter than {least}").when(F.length(s) > most, f"longer than {most}")


def jwt_part(token: Column, part: int) -> Column:
    """The JSON text of a part of a token (0 header, 1 claims)."""
    raw = F.translate(F.get(F.split(token, r"\."), part), "-_", "+/")
    padded = F.concat(raw, F.repeat(F.lit("="), F.pmod(F.lit(4) - F.length(raw) % 4, F.lit(4))))
    return F.decode(F.unbase64(padded), "UTF-8")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex of HMAC-SHA256 with a constant key, from two digests."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), inner), 256)


def pkce_challenge(verifier: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(verifier.cast("binary"), 256))), "+/", "-_"), F.lit("="))


def crc32c(s: Column) -> Column:
    """Castagnoli, byte by byte with a table made from the polynomial."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    t = F.array(*[F.lit(x).cast("long") for x in table])
    octets = F.transform(F.filter(F.split(F.regexp_replace(F.hex(s.cast("binary")), "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    step = lambda c, b: F.shiftrightunsigned(c, 8).bitwiseXOR(F.get(t, c.bitwiseXOR(b).bitwiseAND(F.lit(255).cast("long")).cast("int")))
    return F.aggregate(octets, F.lit(0xFFFFFFFF).cast("long"), step, lambda c: c.bitwiseXOR(F.lit(0xFFFFFFFF).cast("long")))


def hash_embedding(s: Column, dims: int = 384) -> Column:
    """An offline vector: bytes of sha256(text|i) as (b - 128) / 128, normalised to length 1."""
    blocks = -(-dims // 32)
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.sha2(F.concat(s, F.lit("|"), i.cast("string")).cast("binary"), 256)), "")
    raw = F.transform(F.array(hexed), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128))[0]
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # Digests and the length are values of their own: within the inner transforms they would be taken anew for each component.
    return F.transform(F.transform(F.array(raw), lambda v: F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]


def arithmetic_column(s: Column) -> Column:
    """Expressions that differ from row to row have no built-in: an Arrow function, batch by batch."""
    import pandas as pd

    def run(texts):
        import ast
        import re

        # Numbers are digits, a point and an exponent; separators and other bases of the host language aren't.
        plain = re.compile(r"(?:[ \t\n()+*/%-]|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w.]))+")

        def value(n) -> float:
            if isinstance(n, ast.Constant) and type(n.value) in (int, float):
                return float(n.value)
            if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub | ast.UAdd):
                return -value(n.operand) if isinstance(n.op, ast.USub) else value(n.operand)
            if isinstance(n, ast.BinOp):
                a, b = value(n.left), value(n.right)
                if isinstance(n.op, ast.Add):
                    return a + b
                if isinstance(n.op, ast.Sub):
                    return a - b
                if isinstance(n.op, ast.Mult):
                    return a * b
                if isinstance(n.op, ast.Div):
                    return a / b
                if isinstance(n.op, ast.Mod):
                    return a - b * int(a / b)
            raise ValueError

        def one(t):
            try:
                return value(ast.parse(t.strip(), mode="eval").body) if plain.fullmatch(t) else None
            except (ValueError, SyntaxError, ZeroDivisionError, TypeError, OverflowError, RecursionError, MemoryError):
                return None

        return pd.Series([one(t) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR)(s)


NANO = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz-"


def nano_id(size: int = 21, alphabet: str = NANO) -> Column:
    """A random id of ``size`` characters of the alphabet, another one in each row and run."""
    return F.concat(*[F.substr(F.lit(alphabet), (F.floor(F.rand() * len(alphabet)) + 1).cast("int"), F.lit(1)) for _ in range(size)])
