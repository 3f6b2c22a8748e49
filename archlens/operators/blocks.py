"""Blocks of files in languages with braces, told from their text: where each begins and ends, what heads it, how deep it lies.

One pattern reads a file into signs (braces, control words, heads of functions, operators) and steps over strings and
comments whole, so that a brace within one is none. Everything after that is windows along a file's signs: depth is a
running sum over braces, a block's end is the next brace of its depth, its head is the first word since the last border of
statements, and a nesting level is a running sum of what each block adds and takes back at its end. All windows are keyed by
path, so one shuffle of signs serves them all.

Layout that the pattern can't read: a head with a block of its own before its brace (a closure with a body in a loop's
range), and control flow without braces. Files without braces (Python) have no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archlens.config import RuleConfig
from archlens.functions.tables import BLOCK_LAWS, CONFIG_FUNCTIONS, FLUSH_SIGNS, SHELLS, SKELETON_LANGUAGES, TRUSTED_COMMANDS
from archlens.functions.text import has_any, language
from archlens.operators.graph import written_clean
from archlens.operators.joins import dealt, met
from archlens.operators.ranges import within
from archlens.operators.report import maximal
from archlens.operators.rules import governed

_COMMENT = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"
_QUOTED = r'"(?:[^"\\]++|\\.)*+"'
_LITERALS = {
    "rust": rf'\br#"(?:[^"]++|"(?!#))*+"#|\br"[^"]*+"|{_QUOTED}|' + r"'(?:[^'\\\n]|\\[^\n]{1,10}?)'",
    "other": _QUOTED + r"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`",
}
_HEADS = {
    "rust": r"\bfn\s+[A-Za-z_]\w*|\bfor\b|\bimpl\b[^{};]*|\b(?:struct|enum|union|trait|mod|type|static)\s+(?:mut\s+)?[A-Za-z_]\w*|\bconst\s+(?!fn\b|unsafe\b|async\b|extern\b)[A-Za-z_]\w*",
    "other": r"\bfunction\b\s*\*?\s*[A-Za-z_$][\w$]*|\bfunc\s+(?:\([^)\n]*\)\s*)?[A-Za-z_]\w*|\bfor\b(?:[^{};\n]*;[^{};\n]*;)?|\b(?:class|interface|enum|struct|protocol)\s+[A-Za-z_$][\w$]*",
}
_WORDS = r"\b(?:if|else|while|loop|match|switch|try|catch|do|impl|struct|enum|union|trait|mod|class|interface)\b"
_CALLS = r"\.\s*(?:to_string|to_owned)\s*\(|\bBufWriter::new\s*\(|\bCommand::new\s*\(\s*[A-Za-z_]\w*\s*\)"
#: Signs that only rules on lists within brackets ask for.
BRACKETS = r"[()\[\],]"
_SIGNS = r"\|[^|{};\n]*\|\s*(?:->[^{};|\n]*)?\{|=>|&&|\|\||[{};]"

NESTING = ("if", "else_if", "for", "while", "loop", "match", "switch", "try")
LOOPS = ("for", "while", "loop")


def _pattern(lang: str, more: str) -> str:
    sign = "|".join((_HEADS[lang], _WORDS, _CALLS, _SIGNS, *([more] if more else [])))
    return rf"(?s)((?:{_COMMENT}|{_LITERALS[lang]}|(?!{sign})(?:[\w$]++|\s++|.))*+)({sign})"


def signs(files: DataFrame, more: str = "") -> DataFrame:
    """files(path, content) -> path, lang, at (from 0), row of the sign, first and last of its characters (from 1, the last one's successor), sign, before (what stands directly before it, of signs that are calls), joins (whether nothing but white space stands before it). more: a pattern of further signs."""
    content, lang = F.col("content"), language(F.col("path"))
    read = lambda k: F.when(F.col("lang") == "rust", F.regexp_extract_all(content, F.lit(_pattern("rust", more)), F.lit(k))).otherwise(F.regexp_extract_all(content, F.lit(_pattern("other", more)), F.lit(k)))
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    known = dealt(governed(files).select("path", "content", lang.alias("lang")).where("lang IS NOT NULL AND lang <> 'python'"))
    told = F.transform(
        F.arrays_zip(read(1).alias("gap"), read(2).alias("sign")),
        lambda x: F.struct(
            x["sign"].alias("sign"), lines(x["gap"]).alias("gap_lines"), lines(x["sign"]).alias("sign_lines"), F.length(x["gap"]).alias("gap_size"), F.length(x["sign"]).alias("sign_size"),
            F.when(x["sign"].rlike(r"^[.A-Z]"), F.regexp_extract(x["gap"], r"([\w.:&*?()\[\]]*)$", 1)).alias("before"),
            (F.trim(x["gap"]) == "").alias("joins"),
        ),
    )
    each = known.select("path", "lang", F.posexplode(told).alias("at", "s")).select("path", "lang", F.col("at").cast("long"), "s.*")
    upto = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    row = F.sum(F.col("gap_lines") + F.col("sign_lines")).over(upto) - F.col("sign_lines") + 1
    last = F.sum(F.col("gap_size") + F.col("sign_size")).over(upto) + 1
    return each.select("path", "lang", "at", row.cast("int").alias("row"), (last - F.col("sign_size")).alias("first"), last.alias("last"), "sign", "before", "joins")


def _kind(head: Column, second: Column, sign: Column) -> Column:
    word = F.regexp_extract(head, r"^[a-z]+", 0)
    named = F.when(word.isin("fn", "func", "function"), "fn").when((word == "else") & (second == "if"), "else_if").otherwise(word)
    return F.when(F.startswith(sign, F.lit("|")), "closure").otherwise(F.coalesce(named, F.lit("other")))


def in_blocks(found: DataFrame) -> DataFrame:
    """signs with what each is of blocks: opens and closes; depth of the block that it opens or closes, else of the one it lies in; for a brace kind, head (text, row and first of the heading word) and end_at, end_row and end (the successor of the closing brace's place); nest and flow, the levels of nesting within it, and flow_base, the flow level of the function or closure around."""
    c, path = F.col, Window.partitionBy("path").orderBy("at")
    upto, before = path.rowsBetween(Window.unboundedPreceding, 0), path.rowsBetween(Window.unboundedPreceding, -1)
    opens, closes = F.endswith("sign", F.lit("{")), c("sign") == "}"
    border = opens | closes | c("sign").isin(";", "=>")
    rows = found.withColumns({"opens": opens, "closes": closes, "_border": border.cast("int")})
    rows = rows.withColumns({"_sum": F.sum(c("opens").cast("int") - c("closes").cast("int")).over(upto), "_statement": F.coalesce(F.sum("_border").over(before), F.lit(0))})
    rows = rows.withColumn("depth", c("_sum") + c("closes").cast("int"))
    statement = Window.partitionBy("path", "_statement").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    word = F.when(~border & c("sign").rlike(r"^(?!const\b|static\b|type\b)[a-z]"), F.struct(F.col("sign").alias("text"), F.col("row").alias("row"), F.col("first").alias("first"), F.col("at").alias("at")))
    rows = rows.withColumns({"head": F.when(c("opens"), F.first(word, ignorenulls=True).over(statement)), "_second": F.when(c("opens"), F.nth_value(word, 2, ignoreNulls=True).over(statement))})
    rows = rows.withColumn("kind", F.when(c("opens"), _kind(c("head.text"), c("_second.text"), c("sign"))))
    # braces of one depth alternate, so an opening one's neighbour ends its block; a run of if, else if and else is a chain
    brace = c("opens") | c("closes")
    level = Window.partitionBy("path", "depth", F.when(brace, 0).otherwise(1)).orderBy("at")
    rows = rows.withColumns({n: F.when(c("opens"), F.lead(x).over(level)) for n, x in (("end_at", "at"), ("end_row", "row"), ("end", "last"))})
    rows = rows.withColumn("_chain", F.sum(F.when(c("opens") & ~c("kind").isin("else_if", "else"), 1).otherwise(0)).over(level.rowsBetween(Window.unboundedPreceding, 0)))
    chained = Window.partitionBy("path", "depth", F.when(brace, 0).otherwise(1), "_chain").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    links = F.sum(F.when(c("kind") == "else_if", 1).otherwise(0)).over(chained)
    adds = F.when(c("kind").isin("if", "else_if", "else"), 1 + links).when(c("kind").isin(*NESTING), 1).otherwise(0)
    rows = rows.withColumn("_adds", F.when(c("opens"), adds))
    rows = rows.withColumns({"_takes": F.when(c("closes"), F.lag("_adds").over(level)), "_of": F.when(c("closes"), F.lag("kind").over(level))})
    control = lambda kind: kind.isin("if", "else_if", "else", "for", "while", "loop", "match").cast("int")
    resets = lambda kind: kind.isin("fn", "closure").cast("int")
    looped = lambda kind: kind.isin(*LOOPS).cast("int")
    running = lambda f: F.sum(F.coalesce(f(c("kind")), F.lit(0)) - F.coalesce(f(c("_of")), F.lit(0))).over(upto)
    rows = rows.withColumns({"nest": F.sum(F.coalesce("_adds", F.lit(0)) - F.coalesce("_takes", F.lit(0))).over(upto), "flow": running(control), "_resets": running(resets), "loops": running(looped)})
    # of functions and closures that lie in so many, the last one begun is the one around
    around = Window.partitionBy("path", "_resets").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("flow_base", F.coalesce(F.last(F.when(resets(c("kind")) == 1, c("flow")), ignorenulls=True).over(around), F.lit(0)))
    inside = Window.partitionBy("path", "_sum").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"in_kind": F.last(F.when(c("opens"), c("kind")), ignorenulls=True).over(inside), "in_at": F.last(F.when(c("opens"), c("at")), ignorenulls=True).over(inside)})
    return rows.select(*found.columns, "opens", "closes", "depth", "kind", "head", "end_at", "end_row", "end", "nest", "flow", "flow_base", "loops", "in_kind", "in_at")


def marked(files: DataFrame) -> DataFrame:
    """in_blocks' rows of blocks, calls and operators, which are what most rules ask for. They ask several times, so the rows are written once."""
    rows = in_blocks(signs(files)).drop("last", "joins", "closes", "loops", "in_at")
    return written_clean(rows.where(F.col("kind").isNotNull() | F.col("before").isNotNull() | F.col("sign").isin("&&", "||", "=>")))


def functions_of(rows: DataFrame) -> DataFrame:
    """Functions with bodies of in_blocks' rows: path, lang, name, row, end_row, low and high (places of their braces among signs), first and end of the body's characters, base (the level of nesting around)."""
    name = F.regexp_extract("head.text", r"([\w$]+)$", 1)
    return rows.where("kind = 'fn' AND end_at IS NOT NULL").select(
        "path", "lang", name.alias("name"), F.col("head.row").alias("row"), "end_row", F.col("at").alias("low"), F.col("end_at").alias("high"), "first", "end", F.col("nest").alias("base"),
    )


def measured(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """path, low (the place of its body's brace among signs), lang, name, row, end_row of each function, its depth of nesting and the row of what lies deepest (the function's own, if nothing nests), and its cognitive complexity.

    An else-if lies one deeper than the if before it. Complexity counts for Rust each control block once, and once more for
    each that it lies in since the function or closure around (not for an else-if), each arm of a match, and everywhere each
    logical operator. What lies in an inner function counts for the outer one too. rows: the files' marked ones, if known.
    """
    c, rows = F.col, marked(files) if rows is None else rows
    rust = c("lang") == "rust"
    deeper = c("flow") - c("flow_base") - 1  # blocks around within the function or closure
    score = (
        F.when(c("sign").isin("&&", "||"), 1).when(rust & (c("sign") == "=>") & (c("in_kind") == "match"), 1).when(rust & (c("kind") == "else_if"), 1)
        .when(rust & c("kind").isin("if", "for", "while", "loop", "match"), 1 + deeper).otherwise(0)
    )
    nests = c("kind").isin(*NESTING)
    points = rows.select("path", "at", score.alias("score"), F.when(nests, c("nest")).alias("nest"), F.when(nests, c("head.row")).alias("nest_row")).where("score > 0 OR nest IS NOT NULL")
    functions = functions_of(rows)
    held = within(points, functions.select("path", "low", "high", "base"))
    deepest = F.max(F.when(c("nest") > c("base"), F.struct((c("nest") - c("base")).alias("depth"), (-c("at")).alias("at"), c("nest_row").alias("row"))))
    sums = held.groupBy("path", "low").agg(F.sum("score").alias("cognitive"), deepest.alias("deepest"))
    joined = met(functions, sums, ["path", "low"], "left")
    return joined.select(
        "path", "low", "lang", "name", "row", "end_row", F.coalesce("deepest.depth", F.lit(0)).cast("int").alias("depth"), F.coalesce("deepest.row", "row").alias("deepest_row"),
        F.coalesce("cognitive", F.lit(0)).cast("int").alias("cognitive"),
    )


def _found(rows: DataFrame, rule: str, row: Column, *told: Column) -> DataFrame:
    law, message, confidence = BLOCK_LAWS[rule]
    return rows.select("path", row.cast("int").alias("row"), F.lit(law).alias("law"), F.format_string(message, *told).alias("message"), F.lit(confidence).alias("confidence"))


def nesting(functions: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Violations of measured functions that nest too deep."""
    return _found(functions.where(F.col("depth") > config.max_nesting_depth), "nesting", F.col("row"), F.col("name"), F.col("depth"), F.lit(config.max_nesting_depth))


def cognitive(functions: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """Violations of measured functions that are too complex."""
    return _found(functions.where(F.col("cognitive") > config.max_cognitive_complexity), "cognitive", F.col("row"), F.col("name"), F.col("cognitive"), F.lit(config.max_cognitive_complexity))


def nested_loops(files: DataFrame) -> DataFrame:
    """Rust's loops within loops (P04), each told once, in the row of its word."""
    rows = in_blocks(signs(files))
    return _found(rows.where(F.col("kind").isin(*LOOPS) & (F.col("loops") > 1) & (F.col("lang") == "rust")), "nested_loops", F.col("head.row"))


def loop_conversions(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rust's conversions to strings within loops (P02), a row for each loop around; what is the loop's variable, or a part of it, may be converted."""
    rows = (marked(files) if rows is None else rows).where("lang = 'rust'")
    calls = rows.where(F.startswith("sign", F.lit("."))).select("path", "at", F.col("row").alias("call_row"), F.trim("before").alias("receiver"))
    loops = rows.where(F.col("kind").isin(*LOOPS) & F.col("end_at").isNotNull())
    starts = loops.select("path", F.col("at").alias("low"), F.col("end_at").alias("high"), F.col("kind"), F.col("head.first").alias("from"), F.col("first").alias("to"))
    text = F.regexp_extract(F.substring(F.col("content"), F.col("from"), F.col("to") - F.col("from")), r"^for\s+(?:mut\s+)?([^,(]*?)\s*(?:[,(]|\bin\b)", 1)
    named = met(starts, files.select("path", "content"), "path").select("path", "low", "high", F.when(F.col("kind") == "for", text).alias("variable"))
    own = F.coalesce((F.col("receiver") == F.col("variable")) | F.contains("receiver", F.concat("variable", F.lit("."))), F.lit(False))
    return _found(within(calls, named).where(~own), "loop_conversions", F.col("call_row"))


#: The name of a variant with a value, in a pattern.
VARIANT = r"([A-Za-z_][\w:]*)\s*\("
#: What stands for a function's body in a skeleton.
SKELETON_BODY = "{ ... }"


def skeletons(files: DataFrame) -> DataFrame:
    """path, skeleton of files(path, content): the text with the outermost bodies of functions left out. Files without such bodies, and languages that have no skeletons, keep their text. Texts are cut once for each body."""
    bodies = functions_of(in_blocks(signs(files.where(language(F.col("path")).isin(*SKELETON_LANGUAGES)))))
    outer = maximal(bodies.select("path", F.col("first").alias("low"), F.col("end").alias("high")))
    held = outer.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("cuts"))
    content, cuts = F.col("content"), F.col("cuts")
    kept = F.transform(cuts, lambda x, i: F.concat(content.substr(F.when(i > 0, F.get(cuts, i - 1)["high"]).otherwise(1).cast("int"), (x["low"] - F.when(i > 0, F.get(cuts, i - 1)["high"]).otherwise(1)).cast("int")), F.lit(SKELETON_BODY)))
    rest = content.substr(F.element_at(cuts, -1)["high"].cast("int"), F.length(content))
    return met(files, held, "path", "left").select("path", F.when(cuts.isNull(), content).otherwise(F.concat(F.array_join(kept, ""), rest)).alias("skeleton"))


def unflushed_writers(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rust's buffered writers that the function around neither flushes nor hands on (R07)."""
    rows = (marked(files) if rows is None else rows).where("lang = 'rust'")
    made = rows.where(F.startswith("sign", F.lit("BufWriter")) & ~F.endswith("before", F.lit("::"))).select("path", "at", F.col("row").alias("made_row"))
    functions = rows.where("kind = 'fn' AND end_at IS NOT NULL").select("path", F.col("at").alias("low"), F.col("end_at").alias("high"), F.col("head.first").alias("from"), "end")
    nearest = within(made, functions).groupBy("path", "at", "made_row").agg(F.max(F.struct("low", "from", "end")).alias("f"))
    text = F.substring(F.col("content"), F.col("f.from").cast("int"), (F.col("f.end") - F.col("f.from")).cast("int"))
    fine = has_any(text, FLUSH_SIGNS)
    return _found(met(nearest, files.select("path", "content"), "path").where(~fine), "unflushed_writers", F.col("made_row"))


def duplicate_arms(files: DataFrame) -> DataFrame:
    """Rust's matches with arms of the same body (I02), a row for each such body. Arms whose patterns all hold a variant of another name aren't told: what they bind may differ in type.

    An arm's body ends at the next comma of the arrow's own depth, of all brackets; at the brace that closes it, if it is a
    block; or at the match's end.
    """
    c, path = F.col, Window.partitionBy("path").orderBy("at")
    rust = files.where((language(c("path")) == "rust") & F.contains("content", F.lit("match")))
    count = lambda marks: F.length("sign") - F.length(F.translate("sign", marks, ""))
    rows = in_blocks(signs(rust, BRACKETS))
    rows = rows.withColumns({"_net": F.sum(count("([{") - count(")]}")).over(path.rowsBetween(Window.unboundedPreceding, 0)), "_block": (F.lead("sign").over(path) == "{") & F.lead("joins").over(path)})
    arrows = (c("sign") == "=>") & (c("in_kind") == "match")
    level = F.when(arrows | (c("sign") == ","), F.array("_net")).when(c("sign") == "}", F.array("_net", c("_net") + 1))  # a brace may end a body of its own depth, and an arm of the match that it ends
    told = rows.withColumn("_level", F.explode(level))
    back = Window.partitionBy("path", "_level").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("first", "last", "sign")
    ends_list, ends_block = (c("sign") == ",") | ((c("sign") == "}") & (c("_net") < c("_level"))), c("sign").isin(",", "}")
    told = told.withColumns({"_list": F.last(F.when(ends_list, place), ignorenulls=True).over(back), "_any": F.last(F.when(ends_block, place), ignorenulls=True).over(back)}).where(arrows)
    end = F.when(c("_block"), c("_any")).otherwise(c("_list"))
    until = F.when(c("_block") & (end["sign"] == "}"), end["last"]).otherwise(end["first"])
    arms = told.select("path", c("in_at").alias("low"), "at", "first", "last", until.alias("until")).where("until IS NOT NULL")
    heads = rows.where("kind = 'match'").select("path", c("at").alias("low"), c("last").alias("begin"), c("head.row").alias("match_row"))
    arms = met(arms, heads, ["path", "low"]).withColumn("from", F.coalesce(F.lag("until").over(Window.partitionBy("path", "low").orderBy("at")), c("begin")))
    cut = lambda a, b: F.substring(c("content"), a.cast("int"), (b - a).cast("int"))
    texts = met(arms, rust.select("path", "content"), "path").select("path", "low", "match_row", F.regexp_replace(cut(c("from"), c("first")), r"^[,\s]+|\s+$", "").alias("pattern"), F.regexp_replace(cut(c("last"), c("until")), r"^\s+|\s+$", "").alias("body"))
    variants = F.when(F.startswith("pattern", F.lit("(")), F.regexp_extract_all("pattern", F.lit(VARIANT), F.lit(1))).otherwise(F.slice(F.regexp_extract_all("pattern", F.lit(VARIANT), F.lit(1)), 1, 1))
    same = texts.where("body NOT IN ('', '_')").groupBy("path", "low", "match_row", "body").agg(F.count("*").alias("n"), F.collect_list(variants).alias("variants"))
    slots = F.size(c("variants")[0])
    parted = F.forall("variants", lambda v: (F.size(v) == slots) & (F.size(v) > 0)) & F.exists(F.sequence(F.lit(0), F.greatest(slots, F.lit(1)) - 1), lambda k: F.size(F.array_distinct(F.transform("variants", lambda v: F.get(v, k)))) == F.size("variants"))
    return _found(same.where((c("n") > 1) & ~parted), "duplicate_arms", c("match_row"))


def unchecked_commands(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rust's commands made from a variable (X02): a shell by its name is high, any other program medium. Trusted names, constants of the file, functions that read a configuration, and matches over literals around it are left alone."""
    c, rows = F.col, (marked(files) if rows is None else rows).where("lang = 'rust'")
    made = rows.where(F.startswith("sign", F.lit("Command"))).select("path", "at", c("row").alias("made_row"), F.regexp_extract("sign", r"\(\s*(\w+)", 1).alias("name"))
    around = rows.where("kind IN ('fn', 'match') AND end_at IS NOT NULL").select("path", "kind", c("at").alias("low"), c("end_at").alias("high"), c("head.first").alias("from"), c("head.text").alias("head"), "end")
    held = met(within(made, around), files.select("path", "content"), "path")
    text = F.substring(c("content"), c("from").cast("int"), (c("end") - c("from")).cast("int"))
    excused = F.when(c("kind") == "fn", has_any(F.regexp_extract("head", r"(\w+)$", 1), CONFIG_FUNCTIONS)).otherwise(F.contains(text, F.lit('"')))
    safe = held.groupBy("path", "at").agg(F.max(excused).alias("excused"))
    low = F.lower("name")
    trusted = low.rlike("(?:^|_)(?:" + "|".join(TRUSTED_COMMANDS) + ")$")
    judged = met(made, safe, ["path", "at"], "left").where(~F.coalesce("excused", F.lit(False)) & ~trusted)
    judged = met(judged, files.select("path", "content"), "path")
    judged = judged.where(~F.contains("content", F.concat(F.lit("const "), "name")) & ~F.contains("content", F.concat(F.lit("static "), "name")))
    shell = F.lower("name").isin(*SHELLS)
    return _found(judged.where(shell), "shell_commands", c("made_row")).unionByName(_found(judged.where(~shell), "command_sources", c("made_row"), c("name")))


def check(files: DataFrame, config: RuleConfig = RuleConfig()) -> DataFrame:
    """All findings of the rules on blocks."""
    rows = marked(files)
    functions = measured(files, rows)
    parts = (cognitive(functions, config), loop_conversions(files, rows), nested_loops(files), unflushed_writers(files, rows), duplicate_arms(files), unchecked_commands(files, rows))
    out = nesting(functions, config)
    for part in parts:
        out = out.unionByName(part)
    return out
