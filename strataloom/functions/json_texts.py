"""JSON texts as columns: the canonical form, JSON5, and pointers that differ from row to row. What would throw gives null.

Texts are cut into tokens by one pass, so what stands in a string is never taken for anything else, and rewritten by the kind of
token; parsing is Spark's own. All of it stays in built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType, StringType


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


#: What no parser takes: it stands for a token that can't be.
_WRONG = "!"


def js_number(text: Column) -> Column:
    """A JSON number as JavaScript writes the double it stands for; _WRONG for non-finite ones and those it writes with an exponent (1e21 and
    more, less than 1e-6). Up to 15 digits the digits are exact, beyond it they are those of Java's shortest form."""

    def written(d: Column) -> Column:
        digits = F.length(F.regexp_replace(F.regexp_replace(text, "[eE].*|[-.]", ""), "^0+|0+$", ""))
        size, exact = F.abs(d), F.when(digits <= 15, text).otherwise(d.cast("string"))
        plain = F.when(size < 1, exact.try_cast("decimal(38,30)").cast("string")).when(size < 1e16, exact.try_cast("decimal(38,17)").cast("string")).otherwise(exact.try_cast("decimal(38,0)").cast("string"))
        stripped = let(plain, lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x))
        return F.when(d == 0, "0").when((size >= 1e-6) & (size < 1e21), stripped).otherwise(_WRONG)

    return let(text.try_cast("double"), written)


_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def canonical_json(s: Column) -> Column:
    """Keys in the order of their UTF-16 units, no spaces, numbers as JavaScript writes them, strings with the fewest escapes.

    Null for what isn't JSON, for repeated keys, numbers that aren't finite or need an exponent, and nesting beyond what Spark's parser takes. A lone
    surrogate is written as U+FFFD, as in UTF-8.
    """
    # With escaped backslashes and quotes in their long form, a quote always begins or ends a string.
    long = F.replace(F.replace(s, F.lit("\\\\"), F.lit("\\u005c")), F.lit('\\"'), F.lit("\\u0022"))
    lone = r"(?i)\\u(d[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2}\\u)d[c-f][0-9a-f]{2})"
    inside = lambda p: F.when(F.contains(F.lower(p), F.lit("\\ud")), F.regexp_replace(p, lone, r"\\ufffd")).otherwise(p)
    number = lambda t: F.when(t.rlike(_NUMBER), js_number(t)).otherwise(t)
    outside = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(r"-?[0-9][0-9.eE+-]*|[^0-9-]+|-"), 0), number), "")
    parts = F.transform(F.split(long, '"'), lambda p, i: F.when(i % 2 == 1, inside(p)).otherwise(outside(p)))
    structure = F.array_join(F.filter(parts, lambda _, i: i % 2 == 0), '""')
    one = let(F.regexp_extract_all(structure, F.lit(r'""|[{}\[\]:,]|[^\s"{}\[\]:,]+'), 0), _one_value)
    out = F.when(one, F.to_json(F.try_parse_json(F.array_join(parts, '"'))))
    return let(out, lambda x: F.when(F.contains(x, F.lit("\\u00")), _lower_escapes(x)).otherwise(x))


def _lower_escapes(c: Column) -> Column:
    """Control characters' escapes with small hexadecimal digits."""
    for code in (11, *range(14, 16), *range(26, 32)):
        c = F.regexp_replace(c, rf"(?<!\\)((?:\\\\)*+)\\u{code:04X}", rf"$1\\u{code:04x}")
    return c


#: Backslash pairs of JSON5 while it is cut into tokens: \\, \", \', \ before a line end, any other. Noncharacters, which no text should hold.
_BACK, _DOUBLE, _SINGLE, _JOINED, _OTHER = "\ufdd0\ufdd1\ufdd2\ufdd3\ufdd4"
_ENDS = "\\n\\r\u2028\u2029"
_SPACE = f"\\s\u00a0\ufeff\u2028\u2029{_JOINED}"
_TOKENS = f"\"[^\"{_ENDS}]*+\"|'[^'{_ENDS}]*+'|/\\*[\\s\\S]*?\\*/|//[^{_ENDS}{_JOINED}]*+|[{_SPACE}]+|[{{}}\\[\\]:,]|[^{_SPACE}\"'/{{}}\\[\\]:,]+|[\\s\\S]"
_NAME = r"^[\p{L}\p{Nl}$_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}$_\u200c\u200d]*$"


def _json_string(token: Column) -> Column:
    """A string token of JSON5 as one of JSON."""
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    steps = [("\\", _WRONG), ('"', '\\"'), (_BACK, "\\\\"), (_DOUBLE, '\\"'), (_SINGLE, "'"), (_JOINED, ""), (f"{_OTHER}v", "\\u000b"), (f"{_OTHER}0", "\\u0000")]
    for a, b in steps:
        body = F.replace(body, F.lit(a), F.lit(b))
    body = F.regexp_replace(body, f"{_OTHER}x([0-9a-fA-F]{{2}})", r"\\u00$1")
    body = F.regexp_replace(body, f"{_OTHER}([bfnrt]|u[0-9a-fA-F]{{4}})", r"\\$1")
    wrong = body.rlike(f"{_OTHER}[xu]")
    body = F.replace(body, F.lit(_OTHER), F.lit(""))
    bare = body
    for code in range(32):
        bare = F.replace(bare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    body = F.when(body.rlike("[\\x00-\\x1f]"), bare).otherwise(body)
    return F.when(wrong, _WRONG).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def _json_number(token: Column) -> Column:
    """A bare value of JSON5 as JSON; NaN and Infinity stay."""
    sign = F.when(token.startswith("-"), "-").otherwise("")
    size = F.regexp_replace(token, "^[+-]", "")
    hexadecimal = F.conv(F.regexp_replace(size, "^0[xX]", ""), 16, 10)
    point = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(size, "[eE][+-]?$", ""), r"^\.", "0."), r"\.(?=$|[eE])", ""), "^0+(?=[0-9])", "")
    value = F.when(size.rlike("^0[xX][0-9a-fA-F]{1,16}$"), hexadecimal).when(size.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]*)?$"), point).when(size == "Infinity", size)
    return F.when(token.isin("true", "false", "null", "NaN"), token).otherwise(F.coalesce(F.concat(sign, value), F.lit(_WRONG)))


def json5_tokens(s: Column) -> Column:
    """The tokens of a JSON5 text but for white space and comments, with backslash pairs marked."""
    s = F.replace(F.replace(s, F.lit("\\\\"), F.lit(_BACK)), F.lit('\\"'), F.lit(_DOUBLE))
    s = F.regexp_replace(F.replace(s, F.lit("\\'"), F.lit(_SINGLE)), f"\\\\(\\r\\n|[{_ENDS}])", _JOINED)
    s = F.replace(s, F.lit("\\"), F.lit(_OTHER))
    return F.filter(F.regexp_extract_all(s, F.lit(_TOKENS), 0), lambda t: ~t.rlike(f"^([{_SPACE}]|//|/\\*)"))


def _one_value(tokens: Column) -> Column:
    """Whether the brackets close only at the last token, so that nothing stands behind the value."""
    change = lambda t: F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ended"))
    end = F.aggregate(tokens, start, lambda a, t: F.struct((a["depth"] + change(t)).alias("depth"), (a["ended"] + F.when(a["depth"] + change(t) <= 0, 1).otherwise(0)).alias("ended")))
    return (end["depth"] == 0) & (end["ended"] == 1)


def json_of_json5(s: Column) -> Column:
    """A JSON5 text as a JSON text (NaN and Infinity stay as they are); null where more than one value, or none, stands in it.

    Comments, single quotes, joined lines, bare keys, commas at the end, hexadecimal numbers of up to 16 digits, signs and bare points. Tokens that can't
    be make a text that no parser takes.
    """
    def rewritten(tokens: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            after, before = F.get(tokens, i + 1), F.get(tokens, i - 1)
            comma = F.when(after.isin("]", "}") & ~F.coalesce(before.isin("[", "{", ","), F.lit(True)), "").otherwise(t)
            quoted = t.rlike("^[\"'][\\s\\S]")
            bare = F.when(F.coalesce(after == ":", F.lit(False)), F.when(t.rlike(_NAME), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(_WRONG)).otherwise(_json_number(t))
            return F.when(t == ",", comma).when(t.isin("{", "}", "[", "]", ":"), t).when(quoted, _json_string(t)).otherwise(bare)

        return F.when(_one_value(tokens), F.array_join(F.transform(tokens, one), " "))

    return let(json5_tokens(s), rewritten)


def from_json5(s: Column, schema: str) -> Column:
    """A JSON5 text as ``schema``; malformed texts give null, of repeated keys the last one counts."""
    kind = DataType.fromDDL(schema)
    options = {"allowNonNumericNumbers": "true"}
    if not isinstance(kind, StructType):
        return F.from_json(json_of_json5(s), kind, options)
    whole = StructType([*kind.fields, StructField("_wrong", StringType())])
    read = lambda text: F.from_json(text, whole, options | {"columnNameOfCorruptRecord": "_wrong"})
    fields = lambda r: F.struct(*[r[f.name].alias(f.name) for f in kind.fields])
    return let(read(json_of_json5(s)), lambda r: F.when(r.isNotNull() & r["_wrong"].isNull(), fields(r)))


def json_at(doc: Column, pointer: Column) -> Column:
    """What a row's pointer finds in its document: strings as they are, all else as JSON ("null" for a null). Null where nothing is
    found, for a pointer that doesn't begin with a slash, and for texts that aren't JSON or repeat a key."""
    keys = F.transform(F.slice(F.split(pointer, "/"), 2, 1 << 20), lambda k: F.replace(F.replace(k, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))

    def step(v: Column, k: Column) -> Column:
        place = F.when(k.rlike("^(0|[1-9][0-9]{0,8})$"), k.try_cast("int"))
        return F.coalesce(F.get(v.try_cast("array<variant>"), place), F.try_element_at(v.try_cast("map<string,variant>"), k))

    found = F.aggregate(keys, F.try_parse_json(doc), step)
    text = F.to_json(found)
    out = F.when(text.startswith('"'), found.try_cast("string")).otherwise(text)
    return F.when((pointer == "") | pointer.startswith("/"), out)
