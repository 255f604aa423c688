"""Generated code and edits over facts: signatures, constructors, null checks, equality, stubs, fields, variables, fixes.

An edit is a row (doc_id, span_start, span_length, new_text); ``lookup.apply_edits`` splices edits
into the documents. Each operator takes requests as a table, so one plan answers any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.search import first_per_key

EDIT = ("doc_id", "span_start", "span_length", "new_text")


def _block(lines: Column, indent: str = "    ") -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit(indent), x)), "\n")


def camel(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def new_slots() -> Column:
    """Where each parameter of a changed signature comes from, from ``params``, ``removed``, ``renamed``, ``order`` and ``added``.

    A new order lists old names, and those that it leaves out go. Added parameters are inserted one
    after another; a position that is negative, null or beyond the end appends.
    """
    names = F.transform("params", lambda p: p["name"])

    def slot(name: Column) -> Column:
        at = F.array_position(names, name)
        old = F.get(F.col("params"), (at - 1).cast("int"))
        return F.struct(F.coalesce(F.element_at(F.col("renamed"), name), name).alias("name"), old["type"].alias("type"), old["default"].alias("default"), (at - 1).cast("int").alias("old"))

    kept = F.filter(F.coalesce(F.col("order"), names), lambda n: F.array_contains(names, n) & ~F.array_contains("removed", n))

    def insert(slots: Column, a: Column) -> Column:
        new = F.array(F.struct(a["name"].alias("name"), a["type"].alias("type"), a["default"].alias("default"), F.lit(-1).alias("old")))
        at = F.when((a["position"] < 0) | (a["position"] >= F.size(slots)), None).otherwise(a["position"])
        return F.when(at.isNull(), F.concat(slots, new)).otherwise(F.concat(F.slice(slots, F.lit(1), at), new, F.slice(slots, at + 1, F.size(slots))))

    return F.aggregate("added", F.transform(kept, slot), insert)


def change_signature(methods: DataFrame) -> DataFrame:
    """Add ``slots`` and ``new_signature``.

    ``methods``: (method_id, name, return_type, params array<struct<name, type, default>>, removed
    array<string>, renamed map<string, string>, order array<string> or null, added array<struct<name,
    type, default, position>>).
    """
    text = lambda p: F.concat(p["type"], F.lit(" "), p["name"], F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit("")))
    signature = F.concat(F.col("return_type"), F.lit(" "), F.col("name"), F.lit("("), F.array_join(F.transform("slots", text), ", "), F.lit(")"))
    return methods.withColumn("slots", new_slots()).withColumn("new_signature", signature)


def changed_calls(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls with their new argument list.

    ``methods`` as ``change_signature`` returns them; ``calls``: (method_id, call_id, args
    array<struct<name, text>>), the name null for a positional argument. An old argument is found by
    name, else by position if it has no name. Where the call has none, a parameter with a default is
    left out and any other gets ``default``; an added parameter gets its default's text, or ``default``.
    """

    def argument(s: Column) -> Column:
        old_name = F.get(F.col("params"), s["old"])["name"]
        by_name = F.get(F.filter("args", lambda a: a["name"] == old_name), F.lit(0))
        at = F.get(F.col("args"), s["old"])
        found = F.when(by_name.isNotNull(), by_name).when(at["name"].isNull(), at)
        text = F.when(found["name"].isNotNull(), F.concat(s["name"], F.lit(": "), found["text"])).otherwise(found["text"])
        added = F.coalesce(F.nullif(s["default"], F.lit("")), F.lit("default"))
        return F.when(s["old"] < 0, added).when(found.isNotNull(), text).when(s["default"].isNull(), "default")

    texts = F.filter(F.transform("slots", argument), lambda t: t.isNotNull())
    return calls.join(methods.select("method_id", "params", "slots"), "method_id").select("method_id", "call_id", F.concat(F.lit("("), F.array_join(texts, ", "), F.lit(")")).alias("new_args"))


def constructors(members: DataFrame, *, include_properties: bool = False, to_default: bool = False) -> DataFrame:
    """Per type a constructor that sets its instance fields, and its settable properties if asked for.

    ``members``: (type_id, type_name, is_public, ordinal, name, kind, value_type, is_static, is_const,
    is_nullable, can_set). Types without any such member have no row.
    """
    field = (F.col("kind") == "Field") & ~F.col("is_const")
    kept = members.where(~F.col("is_static") & (field | (F.col("kind") == "Property") & F.col("can_set") & F.lit(include_properties)))
    name = F.when(F.col("kind") == "Field", F.regexp_replace("name", "^_+", "")).otherwise(F.col("name"))
    value = F.when(F.col("is_nullable") & F.lit(to_default), F.concat(F.col("param"), F.lit(" ?? default"))).otherwise(F.col("param"))
    kept = kept.withColumn("param", camel(name)).withColumns({"parameter": F.concat("value_type", F.lit(" "), "param"), "line": F.concat(F.lit("    "), "name", F.lit(" = "), value, F.lit(";")), "later": F.col("kind") != "Field"})
    found = kept.groupBy("type_id", "type_name", "is_public").agg(F.sort_array(F.collect_list(F.struct("later", "ordinal", "parameter", "line"))).alias("m"))
    head = F.concat(F.when(F.col("is_public"), "public ").otherwise("internal "), "type_name", F.lit("("), F.array_join(F.transform("m", lambda m: m["parameter"]), ", "), F.lit(")"))
    code = F.concat(head, F.lit("\n{\n"), F.array_join(F.transform("m", lambda m: m["line"]), "\n"), F.lit("\n}"))
    return found.select("type_id", code.alias("code"), F.size("m").alias("n_parameters"))


def null_checks(methods: DataFrame, parameters: DataFrame) -> DataFrame:
    """Per method the guards for its parameters that can be null, as an edit behind the opening brace, or why there is none.

    ``methods``: (method_id, doc_id, body_start), the place after the brace, null without a block;
    ``parameters``: (method_id, ordinal, name, is_reference, is_nullable_value).
    """
    guarded = parameters.where("is_reference or is_nullable_value").groupBy("method_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda p: p["name"]).alias("names"))
    lines = F.array_join(F.transform("names", lambda n: F.concat(F.lit("        ArgumentNullException.ThrowIfNull("), n, F.lit(");\n"))), "")
    error = F.when(F.col("names").isNull(), "no nullable parameters").when(F.col("body_start").isNull(), "method has no body")
    out = methods.join(guarded, "method_id", "left").withColumn("error", error)
    return out.select("method_id", "doc_id", F.col("body_start").alias("span_start"), F.lit(0).alias("span_length"), F.when(F.col("error").isNull(), F.concat(F.lit("\n"), lines)).alias("new_text"), "error")


def equality_members(members: DataFrame, *, operators: bool = True) -> DataFrame:
    """Per type Equals, GetHashCode over its first eight members, and operators.

    ``members``: (type_id, type_name, ordinal, name, kind, is_static, is_const, has_getter): instance
    fields that are no constants and instance properties that can be read are compared.
    """
    kept = members.where(~F.col("is_static") & ((F.col("kind") == "Field") & ~F.col("is_const") | (F.col("kind") == "Property") & F.col("has_getter")))
    found = kept.groupBy("type_id", "type_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda m: m["name"]).alias("names"))
    same = F.array_join(F.transform("names", lambda n: F.concat(n, F.lit(" == other."), n)), " && ")
    name = F.col("type_name")

    def member(head: Column, *body: Column) -> Column:
        return F.concat(head, F.lit("\n{\n"), _block(F.array(*body)), F.lit("\n}"))

    parts = [
        member(F.lit("public override bool Equals(object? obj)"), F.concat(F.lit("return obj is "), name, F.lit(" other && Equals(other);"))),
        member(F.concat(F.lit("public bool Equals("), name, F.lit("? other)")), F.lit("if (other is null) return false;"), F.lit("if (ReferenceEquals(this, other)) return true;"), F.concat(F.lit("return "), same, F.lit(";"))),
        member(F.lit("public override int GetHashCode()"), F.concat(F.lit("return HashCode.Combine("), F.array_join(F.slice("names", 1, 8), ", "), F.lit(");"))),
    ]
    for sign, result in (("==", "return Equals(left, right);"), ("!=", "return !Equals(left, right);")) if operators else ():
        parts.append(member(F.concat(F.lit(f"public static bool operator {sign}("), name, F.lit("? left, "), name, F.lit("? right)")), F.lit(result)))
    return found.select("type_id", F.array_join(F.array(*parts), "\n\n").alias("code"), F.size("names").alias("n_members"))


def member_stubs(missing: DataFrame) -> DataFrame:
    """Per type the members it must still write, each as a stub that throws.

    ``missing``: (type_id, name, kind, value_type, parameters, source); members of abstract bases are overrides.
    """
    head = F.concat(F.lit("public "), F.when(F.col("source") == "abstract", "override ").otherwise(""), "value_type", F.lit(" "), "name")
    throw = F.lit("throw new NotImplementedException();")
    method = F.concat(head, F.lit("("), "parameters", F.lit(") => "), throw)
    value = F.concat(head, F.lit(" { get => "), throw, F.lit(" set => "), throw, F.lit(" }"))
    line = F.when(F.col("kind") == "Method", method).otherwise(value)
    return missing.groupBy("type_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("code"), F.count(F.lit(1)).alias("n_members"))


def encapsulate_fields(fields: DataFrame, refs: DataFrame) -> DataFrame:
    """Edits that make a field private behind a property, and point all references to the property.

    ``fields``: (symbol_id, doc_id, span_start, span_length, name, value_type); ``refs``: (symbol_id,
    doc_id, span_start, span_length). The property has the field's name with a capital; a field that has
    one already gets an underscore.
    """
    bare = F.regexp_replace("name", "^_+", "")
    prop = F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, F.lit(2), F.length("name")))
    own = F.concat(F.lit("_"), camel(bare))
    named = fields.withColumns({"prop": prop, "own": own})
    text = F.concat(F.lit("private "), "value_type", F.lit(" "), "own", F.lit(";\npublic "), "value_type", F.lit(" "), "prop", F.lit(" { get => "), "own", F.lit("; set => "), "own", F.lit(" = value; }"))
    declared = named.select("symbol_id", "doc_id", "span_start", "span_length", text.alias("new_text"))
    used = refs.join(named.select("symbol_id", "prop"), "symbol_id").select("symbol_id", "doc_id", "span_start", "span_length", F.col("prop").alias("new_text"))
    return declared.unionByName(used)


def inline_variables(variables: DataFrame, refs: DataFrame) -> DataFrame:
    """Edits that put a variable's initializer in the place of every reference and take its declaration out.

    ``variables``: (symbol_id, doc_id, span_start, span_length, initializer, is_compound); a compound
    initializer is put in parentheses. A variable that is written again (``is_written``) gives no edits.
    """
    usable = variables.where("initializer is not null and not is_written")
    text = F.when(F.col("is_compound"), F.concat(F.lit("("), "initializer", F.lit(")"))).otherwise(F.col("initializer"))
    out = usable.select("symbol_id", "doc_id", "span_start", "span_length", F.lit("").alias("new_text"))
    return out.unionByName(refs.join(usable.select("symbol_id", text.alias("new_text")), "symbol_id").select(*out.columns))


def extract_variables(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Edits that name an expression: a declaration before its statement, and the name in its place.

    ``requests``: (request_id, doc_id, statement_start, span_start, span_length, name).
    """
    text = F.substring(F.col("text"), F.col("span_start") + 1, F.col("span_length"))
    at = requests.join(documents.select("doc_id", "text"), "doc_id").withColumn("expression", text)
    declare = at.select("request_id", "doc_id", F.col("statement_start").alias("span_start"), F.lit(0).alias("span_length"), F.concat(F.lit("var "), "name", F.lit(" = "), "expression", F.lit(";\n")).alias("new_text"))
    return declare.unionByName(at.select("request_id", "doc_id", "span_start", "span_length", F.col("name").alias("new_text")))


def extract_methods(requests: DataFrame, flow: DataFrame, types: DataFrame, documents: DataFrame, *, accessibility: str = "private") -> DataFrame:
    """Edits that move a region into a method: what flows in becomes parameters, what flows out the result.

    ``requests``: (region_id, doc_id, region_start, region_end, insert_at, name); ``flow`` as
    ``flow.data_flow`` returns it; ``types``: (region_id, variable, value_type). More than one variable
    that flows out cannot be returned: the request gets an ``error`` and no edits.
    """
    kinds = types.groupBy("region_id").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("variable", "value_type")))).alias("kinds"))
    at = requests.join(flow.select("region_id", "flows_in", "flows_out", "declared"), "region_id").join(kinds, "region_id", "left").join(documents.select("doc_id", "text"), "doc_id")
    body = F.substring(F.col("text"), F.col("region_start") + 1, F.col("region_end") - F.col("region_start"))
    kind = lambda v: F.coalesce(F.element_at(F.col("kinds"), v), F.lit("object"))
    result, single = F.get("flows_out", F.lit(0)), F.size("flows_out") == 1
    head = F.concat(F.lit(accessibility + " "), F.when(single, kind(result)).otherwise("void"), F.lit(" "), "name", F.lit("("), F.array_join(F.transform("flows_in", lambda v: F.concat(kind(v), F.lit(" "), v)), ", "), F.lit(")"))
    method = F.concat(F.lit("\n"), head, F.lit("\n{\n"), body, F.when(single, F.concat(F.lit("\nreturn "), result, F.lit(";"))).otherwise(""), F.lit("\n}\n"))
    call = F.concat("name", F.lit("("), F.array_join("flows_in", ", "), F.lit(");"))
    fresh = F.array_contains("declared", result)
    call = F.when(single, F.concat(F.when(fresh, "var ").otherwise(""), result, F.lit(" = "), call)).otherwise(call)
    at = at.withColumns({"call": call, "method": method, "error": F.when(F.size("flows_out") > 1, "more than one result")})
    edits = F.array(F.struct(F.col("region_start").alias("span_start"), (F.col("region_end") - F.col("region_start")).alias("span_length"), F.col("call").alias("new_text")), F.struct(F.col("insert_at").alias("span_start"), F.lit(0).alias("span_length"), F.col("method").alias("new_text")))
    out = at.select("region_id", "doc_id", "error", F.explode_outer(F.when(F.col("error").isNull(), edits)).alias("e"))
    return out.select("region_id", "doc_id", "e.span_start", "e.span_length", "e.new_text", "error")


def code_actions(positions: DataFrame, diagnostics: DataFrame, providers: DataFrame) -> DataFrame:
    """What can be done at each span: one row a title, by kind and title, with how many places offer it.

    ``positions``: (request_id, doc_id, start, end); ``diagnostics``: (doc_id, id, span_start,
    span_end); ``providers``: (id, kind, title), at most a few per id. Spans intersect if they share a
    character or touch.
    """
    hit = positions.join(diagnostics, "doc_id").where((F.col("span_start") <= F.col("end")) & (F.col("start") <= F.col("span_end")))
    return hit.join(providers, "id").groupBy("request_id", "kind", "title").agg(F.count(F.lit(1)).alias("n"))


def action_by_title(requests: DataFrame, actions: DataFrame) -> DataFrame:
    """Per request the action whose title is the one asked for, else the first by title that holds it; null if none does.

    ``requests``: (request_id, wanted); ``actions``: (request_id, title, ...). Case does not matter.
    """
    wanted, title = F.lower("wanted"), F.lower("title")
    both = requests.join(actions, "request_id").where(F.contains(title, wanted))
    best = first_per_key(both.withColumn("rank_", (title != wanted).cast("int")), ["request_id"], ["rank_", "title"]).drop("rank_", "wanted")
    return requests.join(best, "request_id", "left")


#: Diagnostics that a deletion of their span, and of the rest of its line if that is blank, mends.
DELETED = ("CS0168", "CS0219", "CS8019", "CS0162")


def fix_edits(diagnostics: DataFrame, documents: DataFrame) -> DataFrame:
    """Edits that mend the diagnostics that deleting code mends: unused variables and directives, unreachable code.

    ``diagnostics``: (doc_id, id, span_start, span_end). A line that would be blank goes with its break.
    """
    at = diagnostics.where(F.col("id").isin(*DELETED)).join(documents.select("doc_id", "text"), "doc_id")
    before = F.regexp_extract(F.substring(F.col("text"), F.lit(1), F.col("span_start")), r"(?:^|\n)([ \t]*)$", 1)
    alone = F.substring(F.col("text"), F.lit(1), F.col("span_start")).rlike(r"(?:^|\n)[ \t]*$")
    rest = F.regexp_extract(F.substring(F.col("text"), F.col("span_end") + 1, F.length("text")), r"^([ \t]*\n)", 1)
    whole = alone & (F.length(rest) > 0)
    start = F.when(whole, F.col("span_start") - F.length(before)).otherwise(F.col("span_start"))
    end = F.when(whole, F.col("span_end") + F.length(rest)).otherwise(F.col("span_end"))
    return at.select("doc_id", "id", start.cast("int").alias("span_start"), (end - start).cast("int").alias("span_length"), F.lit("").alias("new_text"))


def bracket_errors(text: Column) -> Column:
    """The first thing wrong with the brackets of a snippet, outside of strings and comments; null if nothing is.

    Brackets are taken off in pairs of neighbours until none is left, which needs as many rounds as
    they nest; nesting beyond 64 levels counts as an error too.
    """
    code = F.regexp_replace(text, r'//[^\n]*|(?s:/\*.*?\*/)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', "")
    kinds = F.regexp_replace(code, r"[^(){}\[\]]", "")
    left = F.aggregate(F.sequence(F.lit(1), F.lit(64)), kinds, lambda s, _: F.regexp_replace(s, r"\(\)|\[\]|\{\}", ""))
    open_text = F.regexp_count(code, F.lit('"')) > 0
    return F.when(open_text, "unterminated string").when(F.length(left) > 0, F.concat(F.lit("unbalanced "), F.substring(left, 1, 1)))


def formatted(text: Column) -> Column:
    """Lines without blanks at their end, indented by four blanks for each open brace; lines in a block comment too."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")))
    braces = lambda x, b: F.length(x) - F.length(F.replace(x, F.lit(b), F.lit("")))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        at = F.greatest(s["depth"] - F.when(F.startswith(x, F.lit("}")), 1).otherwise(0), F.lit(0))
        line = F.when(x == "", x).otherwise(F.concat(F.repeat(F.lit("    "), at), x))
        return F.struct(F.greatest(s["depth"] + braces(x, "{") - braces(x, "}"), F.lit(0)).alias("depth"), F.concat(s["done"], F.array(line)).alias("done"))

    return F.array_join(F.aggregate(lines, start, step, lambda s: s["done"]), "\n")
