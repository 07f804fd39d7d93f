"""Source texts as a table of tokens, and what follows from it: rules, control flow, signatures, normal forms.

One regular expression cuts a text into tokens (comments, strings, templates, regular expressions, numbers, names, brackets, marks) that cover it;
simple holes of templates are cut again. Depth, enclosing bracket, statement and neighbours of a token are windows over its source, so
strings and comments never look like code. No syntax tree is built: statements are told by their first token, line ends by the
neighbours. Holes of templates that hold braces or templates stay one token, destructuring within destructuring keeps its names.

Sources are shuffled by id before they are cut, while they are texts. All windows lie within a source, so tokens are never shuffled, and what one token
tells another goes by windows, not by joins: Spark takes a token table for as small as its sources' files, and would broadcast it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_START = r"[\p{L}\p{Nl}$_]"
_NAME = rf"{_START}[\p{{L}}\p{{Nl}}\p{{Mn}}\p{{Mc}}\p{{Nd}}\p{{Pc}}$‌‍]*+"
_BEFORE_PATTERN = r"(?<=(?:^|[=(,:;!&|?{}\[+\-*%~^<>]|\b(?:return|typeof|case|in|of|await|yield|void|delete|throw|else|do))\s{0,99})"
TOKEN = "|".join((
    r"\s++", r"//[^\n\r]*+", r"/\*[\s\S]*?\*/", r'"(?:[^"\\\n]++|\\[\s\S])*+"', r"'(?:[^'\\\n]++|\\[\s\S])*+'", r"`(?:[^`\\]++|\\[\s\S])*+`",
    rf"(?=/){_BEFORE_PATTERN}/(?:[^/\\\n\[]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[a-zA-Z]*+",
    r"0[xXbBoO][0-9a-fA-F_]++n?|(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9]++)?n?", _NAME, r"=>|\?\.(?![0-9])|\?\?|\.\.\.|[\s\S]",
))
_TEXT = r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+"
_STRINGS = r"\"(?:[^\"\\\n]++|\\[\s\S])*+\"|'(?:[^'\\\n]++|\\[\s\S])*+'"
_WITH_HOLES = rf"^`{_TEXT}(?:\$\{{(?:[^{{}}`\"']++|{_STRINGS})*+\}}{_TEXT})++`$"
_PIECE = rf"[`}}]{_TEXT}(?:\$\{{|`)|(?:[^`}}\"']++|{_STRINGS})++"

#: The rules, in their order; names that make a member access reflection; what may begin a statement that isn't an expression.
RULES = ("any_type", "eval", "reflection", "with", "mutable_global", "throw_non_error", "top_level_effect", "untyped_import")
REFLECTION = ("getPrototypeOf", "setPrototypeOf", "getOwnPropertyDescriptor", "getOwnPropertyDescriptors", "defineProperty", "defineProperties")
DECLARES = ("export", "interface", "enum", "class", "abstract", "function", "namespace", "module", "declare", "const", "let", "var")
CONTROLS = ("if", "for", "while", "do", "switch", "try", "throw", "return", "with", "break", "continue", "debugger")
#: Names that go on with an expression or statement, before which no line end counts; those after which none counts.
GOES_ON = ("in", "of", "instanceof", "as", "satisfies", "extends", "implements", "from", "else", "catch", "finally")
WANTS_MORE = (*GOES_ON, "import", "export", "default", "type", "interface", "enum", "class", "abstract", "function", "async", "namespace", "module", "declare", "const", "let", "var", "new", "typeof", "void", "delete", "await", "do", "try", "throw", "case")
#: Before a brace that isn't a block.
BEFORE_OBJECT = ("=", "(", ",", "[", ":", "?", "??", "|", "&", "!", "+", "...", "return", "of", "in", "default", "throw", "await", "yield", "case", "typeof")
_WORDS = (*WANTS_MORE, *CONTROLS, "true", "false", "null", "this", "super", "yield", "static", "public", "private", "protected", "readonly", "undefined")


#: Characters of a partition of sources; their tokens are some forty times as many bytes.
CHARS = 2_000_000


def _dealt(sources: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _text) in as many partitions by id as the texts' length asks for."""
    rows = sources.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    chars = rows.agg(F.sum(F.char_length("_text"))).first()[0] or 0
    return rows.repartition(max(sources.sparkSession.sparkContext.defaultParallelism, -(-chars // CHARS)), "id")


def tokens(sources: DataFrame, id_col: str = "id", text_col: str = "source") -> DataFrame:
    """(id, place, kind, token, at): all tokens of each text, white space and comments too; at is the offset, so the tokens joined are the text.

    kinds: space, comment, string, template, regex, number, name, open, close, mark. Null texts have no tokens.
    """
    cut = lambda t: F.regexp_extract_all(t, F.lit(TOKEN), 0)
    pieces = lambda t: F.flatten(F.transform(F.regexp_extract_all(t, F.lit(_PIECE), 0), lambda p: F.when(p.rlike("^[`}]"), F.array(p)).otherwise(cut(p))))
    whole = F.flatten(F.transform(cut(F.col("_text")), lambda t: F.when(t.rlike(_WITH_HOLES), pieces(t)).otherwise(F.array(t))))
    rows = _dealt(sources, id_col, text_col).select("id", F.posexplode(whole).alias("place", "token"))
    t = F.col("token")
    kind = (
        F.when(t.rlike(r"^\s"), "space").when(t.rlike("^/[/*]"), "comment").when(t.rlike(r"^[`}][\s\S]*(\$\{|`)$"), "template").when(t.rlike("^[\"'][\\s\\S]"), "string").when(t.rlike(r"^/[\s\S]"), "regex")
        .when(t.rlike(r"^\.?[0-9]"), "number").when(t.rlike(rf"^{_START}"), "name").when(t.isin("(", "[", "{"), "open").when(t.isin(")", "]", "}"), "close").otherwise("mark")
    )
    before = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("kind", kind).withColumn("at", F.coalesce(F.sum(F.char_length("token")).over(before), F.lit(0)).cast("int"))


def code(found: DataFrame) -> DataFrame:
    """The tokens that are neither space nor comment, with what surrounds them.

    p1..p3, n1, n2: tokens before and after, kp their kind before; depth: brackets around (of a bracket itself: those around it); scope: place of the
    innermost opening bracket around, null at the top, scope_end: of its partner; closed, follows: of an opening bracket, the place of its partner and the token
    behind that; head: of a closing bracket, the token before its partner; last_head: head of the token before; stmt: number of the statement within its scope,
    begins: whether it starts there; doc: the comment block right in front.
    """
    w = Window.partitionBy("id").orderBy("place")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    blank = F.col("kind").isin("space", "comment")
    rows = found.withColumns({
        "lines": F.sum(F.when(blank & F.col("token").rlike("[\\n\\r  ]"), 1).otherwise(0)).over(w),
        "note": F.last(F.when(F.col("kind") == "comment", F.struct("place", "token")), True).over(before),
    }).where(~blank)
    opens, closes = F.col("kind") == "open", F.col("kind") == "close"
    side = lambda c, k: F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w)
    rows = rows.withColumns({
        "after_line": F.coalesce(F.col("lines") > side("lines", 1), F.lit(False)), "p1": side("token", 1), "p2": side("token", 2), "p3": side("token", 3), "kp": side("kind", 1), "n1": side("token", -1), "n2": side("token", -2), "last_place": side("place", 1),
        "depth": (F.coalesce(F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(before), F.lit(0)) - F.when(closes, 1).otherwise(0)).cast("int"),
    })
    doc = F.when((F.col("note.place") > F.coalesce("last_place", F.lit(-1))) & F.col("note.token").startswith("/**"), F.col("note.token"))
    # Each opening bracket also stands, as an opener, among the tokens one level deeper, so that a window there can look back to it. Between a bracket and its
    # partner nothing stands at their own level, so there they are neighbours.
    copied = F.explode(F.when(opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    rows = rows.withColumn("doc", doc).drop("note", "lines").withColumn("opener", copied).withColumn("level", F.col("depth") + F.col("opener").cast("int"))
    inner = Window.partitionBy("id", "level").orderBy("place")
    own_open = F.when(opens & ~F.col("opener"), F.col("p1"))
    rows = rows.withColumns({
        "scope": F.last(F.when(F.col("opener"), F.col("place")), True).over(inner.rowsBetween(Window.unboundedPreceding, -1)),
        "closed": F.when(opens, F.lead("place").over(inner)), "follows": F.when(opens, F.lead("n1").over(inner)), "head": F.when(closes, F.lag(own_open).over(inner)),
        "last_head": F.when(~closes & (F.col("kp") == "close"), F.lag(own_open, 2).over(inner)),
    }).where(~F.col("opener")).drop("opener", "level")
    begins_line = F.col("kind").isin("name", "number", "string") & ~F.col("token").isin(*GOES_ON)
    ended = F.col("kp").isin("name", "number", "string", "template", "regex", "close") & ~F.coalesce(F.col("p1").isin(*WANTS_MORE), F.lit(False)) & ~((F.col("p1") == ")") & F.coalesce(F.col("last_head").isin("if", "for", "while", "with"), F.lit(False)))
    begins = F.col("p1").isNull() | (F.col("p1") == ";") | (F.col("last_place") == F.col("scope")) | ((F.col("p1") == "}") & begins_line & (F.col("kp") == "close")) | (F.col("after_line") & begins_line & ended)
    rows = rows.withColumn("begins", F.coalesce(begins, F.lit(False)) & ~closes)
    rows = _within(rows, {"scope_end": F.col("closed")})
    return rows.withColumn("stmt", F.sum(F.col("begins").cast("int")).over(Window.partitionBy("id", "scope").orderBy("place")).cast("int"))


def _within(rows: DataFrame, what: dict[str, Column]) -> DataFrame:
    """rows with columns that say something of the bracket right around; null at the top."""
    opens = F.col("kind") == "open"
    rows = rows.withColumn("copy", F.explode(F.when(opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    rows = rows.withColumns({"scope": F.when(F.col("copy"), F.col("place")).otherwise(F.col("scope")), "told": F.when(F.col("copy"), F.struct(*[c.alias(n) for n, c in what.items()]))})
    rows = rows.withColumn("told", F.first("told", True).over(Window.partitionBy("id", "scope").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("copy"))
    return rows.withColumns({n: F.col("told")[n] for n in what}).drop("copy", "told")


def _is(c: str, *values: str) -> Column:
    return F.coalesce(F.col(c).isin(*values), F.lit(False))


def _member() -> Column:
    """Whether a name stands behind a point."""
    return _is("p1", ".", "?.")


def broken_rules(rows: DataFrame) -> DataFrame:
    """(id, rules): the rules that a source breaks, in their order; sources that break none have no row. rows: ``code``."""
    t = "token"
    name = F.col("kind") == "name"
    any_type = _is(t, "any") & ~_is("n1", "(", ".", ":") & (_is("p1", ":", "as", "<", "|", "&", "extends", "keyof", "readonly", "satisfies", "is") | (_is("p1", "=") & _is("p3", "type")) | (_is("p1", ",") & _is("n1", ">", "[", ",")) | (_is("p1", "=>") & _is("n1", ";", ")", ",", "|", "=")))
    evaluates = _is(t, "eval", "Function") & ~_member() & ~_is("p1", "function") & (_is("n1", "(") | (_is(t, "Function") & _is("p1", "new")))
    reflects = (_is(t, "Reflect") & ~_member() & _is("n1", ".", "?.")) | (_is(t, "Object") & ~_member() & _is("n1", ".", "?.") & _is("n2", *REFLECTION)) | (_is(t, "__proto__") & _member()) | (_is(t, '"__proto__"', "'__proto__'") & _is("p1", "[") & _is("n1", "]"))
    top = F.col("scope").isNull()
    mutable = top & _is(t, "let", "var") & (F.col("begins") | _is("p1", "export", "declare")) & ~_is("n1", "=", ".", "(")
    in_stmt = Window.partitionBy("id", "scope", "stmt")
    thrown = F.min(F.when(F.col(t).eqNullSafe("throw") & F.col("begins"), F.col("place"))).over(in_stmt)
    first = F.col("kind").isin("string", "template", "number", "regex", "open", "mark") | _is(t, "null", "true", "false", "typeof", "void", "delete", "function", "class", "async") | (_is(t, "this", "super") & ~_is("n1", ".", "?."))
    later = ((F.col("kind") == "mark") & ~_is(t, ".", "?.", ";", "<", ">", ",")) | _is(t, "[") | (F.col("kind") == "template") | (_is(t, "as", "satisfies", "in", "instanceof") & ~_member())
    non_error = (F.col("thrown") < F.col("place")) & F.when(_is("p1", "throw"), first).otherwise(later)
    declared = _is(t, *DECLARES, *CONTROLS, ";", "@", "{") | (_is(t, "import") & ~_is("n1", "(", ".")) | (_is(t, "type") & ~_is("n1", "=", ".", "(", ";")) | (_is(t, "async") & _is("n1", "function")) | _is("n1", ":")
    effect = top & F.col("begins") & ~declared
    untyped = (_is(t, "require") | _is(t, "import")) & ~_member() & _is("n1", "(")
    tests = {"any_type": name & any_type, "eval": evaluates, "reflection": reflects, "with": _is(t, "with") & F.col("begins") & _is("n1", "("), "mutable_global": mutable, "throw_non_error": non_error, "top_level_effect": effect, "untyped_import": untyped}
    hits = F.array_compact(F.array(*[F.when(tests[r], F.lit(i)) for i, r in enumerate(RULES)]))
    got = rows.withColumn("thrown", thrown).select("id", F.explode(hits).alias("i")).groupBy("id").agg(F.sort_array(F.collect_set("i")).alias("i"))
    return got.select("id", F.transform("i", lambda i: F.element_at(F.array(*map(F.lit, RULES)), i + 1)).alias("rules"))


def _boundaries() -> Column:
    words = F.col("token").isin("if", "for", "while", "do", "switch", "try") & ~_member() & ~_is("n1", ":")
    # The while of a do loop: the brace before it was opened right after do.
    closing = _is("token", "while") & _is("p1", "}") & _is("last_head", "do")
    choice = _is("token", "?") & ~_is("n1", ":", ")", ",", ";", "=", "(", "<", "]", "}")
    return F.count_if((words & ~closing) | choice).cast("int").alias("boundaries")


def control_flow(rows: DataFrame) -> DataFrame:
    """(id, boundaries): statements and conditional expressions that branch, for each source with a token."""
    return rows.groupBy("id").agg(_boundaries())


def signatures(sources: DataFrame, rows: DataFrame, id_col: str = "id", text_col: str = "source") -> DataFrame:
    """(id, name, params, result, doc, has_body) of the first exported function or function constant of each source; others have no row.

    params: (name, type) in order; a type that isn't written is "unknown". rows: ``code`` of the same sources.
    """
    top = F.col("scope").isNull()
    # Tokens that aren't at the top stand alone here.
    in_stmt = Window.partitionBy("id", "own_stmt").orderBy("place")
    ahead = in_stmt.rowsBetween(0, Window.unboundedFollowing)
    flat = rows.withColumn("own_stmt", F.when(top, F.col("stmt")).otherwise(-1 - F.col("place")))
    is_function = _is("token", "function") & (_is("p1", "export", "default") | (_is("p1", "async") & _is("p2", "export", "default")))
    named = F.when(is_function, F.when(_is("n1", "*"), F.col("n2")).otherwise(F.col("n1"))).when(_is("token", "const", "let", "var") & _is("p1", "export"), F.col("n1"))
    nth = lambda cond: F.first(F.when(cond, F.col("place")), True).over(ahead)
    arrow = nth(_is("token", "=>") | _is("token", "function"))
    flat = flat.withColumns({
        "name": named, "lo": nth(_is("token", "(")), "eq": nth(_is("token", "=")), "arrow": arrow, "end": F.last("place").over(ahead), "start_doc": F.first("doc", True).over(in_stmt.rowsBetween(Window.unboundedPreceding, 0)),
        "brace": F.last(F.when(_is("token", "{"), F.struct("place", "n1")), True).over(ahead), "first_arrow": nth(_is("token", "=>")),
    }).withColumn("hi", F.first(F.when(F.col("place") == F.col("lo"), F.col("closed")), True).over(ahead))
    constant = F.col("token") != "function"
    good = top & F.col("name").isNotNull() & F.col("lo").isNotNull() & (~constant | ((F.col("eq") < F.col("lo")) & F.col("arrow").isNotNull()))
    told = F.struct("name", "lo", "hi", "end", "first_arrow", "brace", constant.alias("constant"), "start_doc", F.col("place").alias("first_place"))
    chosen = F.min_by(F.when(good, told), F.when(good, F.col("place"))).over(Window.partitionBy("id"))
    found = flat.withColumn("f", chosen).where("f is not null").select("id", "place", "token", "at", "scope", "f", "f.lo", "f.hi", "f.end", "f.constant", "f.first_arrow", "f.brace")
    stop = F.when(F.col("constant") & F.col("first_arrow").isNotNull(), F.col("first_arrow")).otherwise(F.col("brace.place"))
    inside = found.withColumn("stop", stop).withColumn("is_first", F.col("place") == F.col("f.first_place")).where("is_first or place > lo and place < coalesce(stop, end + 1)")
    by = Window.partitionBy("id").orderBy("place")
    own = (F.col("scope") == F.col("lo")) & (F.col("place") < F.col("hi"))
    angle = F.coalesce(F.sum(F.when(own & _is("token", "<"), 1).when(own & _is("token", ">"), -1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The first token of all is kept, as part -2, for a function without a parameter and result.
    inside = inside.withColumn("flat", own & (angle == 0)).withColumn("part", F.when(F.col("place") <= F.col("lo"), -2).when(F.col("place") < F.col("hi"), F.sum(F.when(F.col("flat") & _is("token", ","), 1).otherwise(0)).over(by)).when(F.col("place") > F.col("hi"), -1))
    inside = inside.where("part is not null and not (flat and token = ',')")
    per = Window.partitionBy("id", "part").orderBy("place")
    seen = lambda token: F.coalesce(F.sum(F.when((F.col("flat") | (F.col("part") == -1)) & _is("token", token), 1).otherwise(0)).over(per), F.lit(0))
    inside = inside.withColumns({"colon": seen(":"), "equal": seen("=")})
    spanned = lambda cond: F.struct(F.min(F.when(cond, F.col("at"))).alias("a"), F.max(F.when(cond, F.col("at") + F.char_length("token"))).alias("z"))
    is_colon = _is("token", ":") & (F.col("flat") | (F.col("part") == -1))
    first_colon = is_colon & (F.col("colon") == 1)
    parts = inside.groupBy("id", "part").agg(F.first("f").alias("f"), spanned((F.col("colon") == 0) & (F.col("equal") == 0) & ~(F.col("flat") & _is("token", "?"))).alias("n"), spanned((F.col("colon") > 0) & ~first_colon & (F.col("equal") == 0)).alias("t"))
    piece = lambda s: F.trim(F.regexp_replace(F.expr(f"substring(_text, {s}.a + 1, {s}.z - {s}.a)"), r"\s+", " "))
    parts = parts.join(_dealt(sources, id_col, text_col).hint("merge"), "id").select("id", "f", "part", piece("n").alias("name"), piece("t").alias("type"))
    listed = F.sort_array(F.collect_list(F.when((F.col("part") >= 0) & F.col("name").isNotNull(), F.struct("part", "name", "type")))).alias("p")
    out = parts.groupBy("id").agg(F.first("f").alias("f"), listed, F.max(F.when(F.col("part") == -1, F.col("type"))).alias("result"))
    params = F.transform("p", lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["type"], F.lit("unknown")).alias("type")))
    return out.select("id", "f.name", params.alias("params"), F.coalesce("result", F.lit("unknown")).alias("result"), F.col("f.start_doc").alias("doc"), (F.col("f.brace.n1") != "}").alias("has_body"))


def documentation(doc: Column) -> Column:
    """A comment block as (summary, params, returns, requires, ensures, throws): the first sentence of its text and what its tags say."""
    body = F.regexp_replace(F.regexp_replace(doc, r"^/\*\*|\*/$", ""), r"(?m)^[ \t]*\*[ \t]?", "")
    parts = F.split(body, r"(?m)^\s*(?=@\w)")
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    sentence = F.regexp_extract(flat(F.get(parts, F.lit(0))), r"^(.*?[.!?])(?:\s|$)|^(.*)$", 0)
    tag = lambda *names: F.filter(F.transform(F.filter(parts, lambda p: p.rlike(rf"^@({'|'.join(names)})\b")), lambda p: flat(F.regexp_replace(p, r"^@\w+\s*", ""))), lambda x: x != "")
    param = F.transform(tag("param"), lambda x: F.struct(F.regexp_extract(x, rf"^(?:\{{[^}}]*\}}\s*)?({_NAME})", 1).alias("name"), F.regexp_replace(x, rf"^(?:\{{[^}}]*\}}\s*)?{_NAME}\s*-?\s*", "").alias("text")))
    return F.when(doc.isNotNull(), F.struct(F.nullif(F.trim(sentence), F.lit("")).alias("summary"), param.alias("params"), F.get(tag("returns", "return"), F.lit(0)).alias("returns"), tag("requires").alias("requires"), tag("ensures").alias("ensures"), tag("throws", "throw", "exception").alias("throws")))


def single_typed_function(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """(id, single) for each source with a token: whether imports, types and re-exports aside it is one exported function with typed parameters, a result type, a
    comment block and a body. rows: ``code``, signed: ``signatures``."""
    return atoms(rows, signed).where("single is not null").select("id", "single")


def atoms(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """(id, boundaries, single): ``control_flow`` and ``single_typed_function`` in one pass over the tokens."""
    head = F.col("scope").isNull() & F.col("begins")
    reexport = _is("token", "export") & (_is("n1", "{", "*", "type", "interface"))
    noise = (_is("token", "import") & ~_is("n1", "(", ".")) | reexport | _is("token", "interface", "type")
    counts = rows.groupBy("id").agg(_boundaries(), F.count_if(head).alias("heads"), F.count_if(head & ~noise).alias("others"))
    typed = signed.select("id", (F.forall("params", lambda p: p["type"] != "unknown") & (F.col("result") != "unknown") & F.col("doc").isNotNull() & F.coalesce("has_body", F.lit(False))).alias("typed"))
    single = F.when(F.col("heads") > 0, (F.col("others") == 1) & F.coalesce("typed", F.lit(False)))
    return counts.join(typed.hint("merge"), "id", "left").select("id", "boundaries", single.alias("single"))


def canonical_sources(rows: DataFrame) -> DataFrame:
    """(id, canonical): tokens joined by single spaces without comments, locals named __v0, __v1 ... in the order of their declaration.

    Locals are variables (not exported ones), parameters of functions (not of exported declarations or methods) and of catch clauses. Each name is told by the innermost
    declaration around it; properties keep their names, and a shorthand property is written out. rows: ``code``.
    """
    behind = Window.partitionBy("id", "scope").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    in_scope = Window.partitionBy("id", "scope").orderBy("place")
    nearest = lambda cond, value="place": F.last(F.when(cond, F.col(value)), True).over(behind)
    # Within a statement: what is counted in the scope, less what was counted before the statement.
    angles = F.when(_is("token", "<"), 1).when(_is("token", ">"), -1).otherwise(0)
    is_word = _is("token", "const", "let", "var")
    marks = rows.withColumns({"angles": F.sum(angles).over(in_scope) - angles, "words": F.sum(is_word.cast("int")).over(in_scope)})
    start = F.last(F.when(F.col("begins"), F.struct("angles", (F.col("words") - is_word.cast("int")).alias("words"), "token")), True).over(in_scope.rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.withColumn("start", start).withColumns({
        "word": F.col("words") > F.coalesce("start.words", F.lit(0)), "exported": F.col("start.token").eqNullSafe("export") & F.col("scope").isNull(), "angle": F.col("angles") - F.coalesce("start.angles", F.lit(0)),
    }).drop("angles", "words", "start")
    marks = marks.withColumns({
        "next_brace": nearest(_is("token", "}")), "next_end": nearest(_is("token", ",", ";")), "arrow_body": nearest(_is("token", "=>"), "n1"), "arrow_at": nearest(_is("token", "=>")),
    })
    # Of each opening bracket: whether it holds parameters, a loop's head, a pattern, or an object.
    is_function = _is("p1", "function") | _is("p2", "function") | (_is("p1", "*") & _is("p2", "function"))
    lambda_head = _is("follows", "=>") | (_is("follows", ":") & ~_is("p1", "?") & F.col("arrow_at").isNotNull() & (F.coalesce("next_end", F.lit(1 << 30)) > F.col("arrow_at")))
    paren = F.col("token") == "("
    role = (
        F.when(paren & is_function, F.when(F.col("exported"), "other").otherwise("function")).when(paren & _is("p1", "catch"), "function").when(paren & (_is("p1", "for") | _is("p2", "for")), "loop").when(paren & lambda_head, "lambda")
        .when(F.col("token").isin("{", "[") & F.col("p1").isin("const", "let", "var") & ~F.col("exported"), "pattern").when((F.col("token") == "{") & _is("p1", *BEFORE_OBJECT), "object").otherwise("other")
    )
    far = F.lit(1 << 30)
    body = F.when((role == "lambda") & ~F.col("arrow_body").eqNullSafe("{"), F.coalesce(F.when(F.col("next_end") > F.col("arrow_at"), F.col("next_end")), "scope_end", far)).otherwise(F.coalesce("next_brace", "scope_end", far))
    # What follows from a token's neighbours is told before they are dropped.
    plain = (F.col("kind") == "name") & ~F.col("token").isin(*_WORDS) & (F.col("angle") == 0)
    tests = {
        "may_vary": plain & (_is("p1", "const", "let", "var") | (_is("p1", ",") & F.col("word") & _is("n1", "=", ":", ",", ";", "!"))) & ~F.col("exported"),
        "may_be_parameter": plain & _is("p1", "(", ",", "...") & _is("n1", ":", "?", ",", ")", "="), "may_be_bound": plain & _is("p1", "{", "[", ",", ":", "...") & _is("n1", ",", "}", "]", "="),
        "bare": plain & _is("n1", "=>") & ~_member() & ~_is("p1", ")", ":"), "may_be_key": _is("n1", ":") & _is("p1", "{", ","), "may_be_short": _is("p1", "{", ",") & _is("n1", ",", "}", "="),
        "is_name": (F.col("kind") == "name") & ~_member() & ~F.col("token").isin(*_WORDS),
    }
    bare_end = F.when(F.col("n2") == "{", F.col("next_brace")).otherwise(F.coalesce("next_end", "scope_end", far))
    flat = marks.select("id", "place", "token", "kind", "scope", "scope_end", role.alias("own_role"), body.alias("own_body"), F.when(tests["bare"], bare_end).alias("bare_end"), *[c.alias(n) for n, c in tests.items()])
    named = _within(flat, {"role": F.col("own_role"), "body": F.col("own_body"), "outer": F.col("scope"), "outer_close": F.col("scope_end")})
    variable = F.col("may_vary") & ~_is("role", "pattern", "object", "lambda", "function")
    parameter = F.col("may_be_parameter") & _is("role", "function", "lambda")
    in_pattern = F.col("may_be_bound") & _is("role", "pattern")
    bare = F.col("bare")
    lo = F.when(parameter, F.col("scope")).when(in_pattern, F.coalesce("outer", F.lit(-1))).when(bare, F.col("place")).otherwise(F.coalesce("scope", F.lit(-1)))
    hi = F.when(parameter | (variable & _is("role", "loop")), F.col("body")).when(in_pattern, F.coalesce("outer_close", far)).when(bare, F.col("bare_end")).otherwise(F.coalesce("scope_end", far))
    is_key = F.col("may_be_key") & _is("role", "object", "pattern")
    is_use = F.col("is_name") & ~is_key
    short = F.col("may_be_short") & _is("role", "object", "pattern") & ~F.col("scope").isNull()
    declares = F.when(variable | parameter | in_pattern | bare, F.struct(lo.alias("lo"), (-F.col("place")).alias("back"), hi.alias("hi")))
    told = named.select("id", "place", "token", is_use.alias("is_use"), short.alias("short"), declares.alias("own"))
    told = told.withColumn("all", F.collect_list("own").over(Window.partitionBy("id", "token")))
    # The innermost declaration around, of those that begin together the first; and whether a declaration is the first of its reach.
    by = F.array_max(F.filter("all", lambda d: (F.col("place") >= d["lo"]) & (F.col("place") <= d["hi"])))
    new = ~F.exists("all", lambda d: (d["lo"] == F.col("own.lo")) & (d["hi"] == F.col("own.hi")) & (d["back"] > F.col("own.back")))
    told = told.select("id", F.struct("place", "token", "short", F.when(F.col("is_use"), -by["back"]).alias("by")).alias("t"), F.when(F.col("own").isNotNull() & new, F.col("place")).alias("new"))
    whole = told.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("t"), F.sort_array(F.collect_list("new")).alias("new"))

    def written(x: Column) -> Column:
        local = F.concat(F.lit("__v"), (F.array_position(F.col("new"), x["by"]) - 1).cast("string"))
        return F.when(x["by"].isNull(), x["token"]).when(x["short"], F.concat(x["token"], F.lit(" : "), local)).otherwise(local)

    return whole.select("id", F.array_join(F.transform("t", written), " ").alias("canonical"))
