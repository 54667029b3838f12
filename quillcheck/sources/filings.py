"""Filings in inline XBRL: facts with their periods and units, and the statements that present their concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.markup import each_match
from ..operators.trees import tree_places

#: Names of number formats in filings, and numbers written as words.
ZERO_FORMATS = ["fixed-zero", "fixedzero", "zerodash"]
COMMA_FORMATS = ["num-comma-decimal", "numcommadecimal", "numdotcomma", "numspacecomma"]
WORD_FORMATS = ["numwordsen", "num-words-en"]
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
NO_WORDS = ["no", "none", "nil"]
#: How a role's definition names a face statement, and what makes it none.
STATEMENT, ASIDE = r"(?i)\s-\s*statement\s*-\s", "(?i)parenthetical"

_P = r"(?:[\w.-]+:)?"  # any prefix, or none


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in single or double quotes; null where it is missing or empty."""
    found = [F.nullif(F.regexp_extract(tag, rf"(?:^|\s){name}\s*=\s*{q}([^{q}]*){q}", 1), F.lit("")) for q in "\"'"]
    out = F.coalesce(*found)
    for sign, stands in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}.items():
        out = F.replace(out, F.lit(sign), F.lit(stands))
    return out


def _elements(rows: DataFrame, keep: list[str], xml: Column, name: str) -> DataFrame:
    """One row an element that has content: keep, place, its tag's attributes and what it holds. An empty element
    written as one tag does not run on to the next one's end."""
    pattern = rf"(?s)<{_P}{name}\b([^>]*)(?<!/)>(.*?)</{_P}{name}\s*>"
    return rows.select(*keep, F.posexplode(each_match(xml, pattern, 2)).alias("at", "m")).select(*keep, "at", F.col("m")[0].alias("tag"), F.col("m")[1].alias("body"))


def _one(body: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(body, rf"(?s)<{_P}{name}\b[^>]*>(.*?)</{_P}{name}\s*>", 1)), F.lit(""))


def _last(rows: DataFrame, keep: list[str], key: str, value: Column) -> DataFrame:
    """The value of the last element with each key, in the order of the text."""
    return rows.where(F.col(key).isNotNull()).groupBy(*keep, key).agg(F.max_by(value, "at").alias("v"))


def contexts(pages: DataFrame, keep: list[str], html: str) -> DataFrame:
    """Each context: its id, the entity, an ``instant`` or ``start`` and ``end`` as dates, and ``members``, sorted, as
    axis=member. Of an id that comes twice the last counts. A date that cannot be read is null."""
    rows = _elements(pages, keep, F.col(html), "context").withColumn("context", _attribute(F.col("tag"), "id"))
    day = lambda name: F.substring(_one(F.col("body"), name), 1, 10).try_cast("date").alias(name)
    members = F.transform(each_match(F.col("body"), rf"<{_P}explicitMember\b([^>]*)>\s*([^<]*?)\s*<", 2), lambda m: F.concat(_attribute(m[0], "dimension"), F.lit("="), m[1]))
    value = F.struct(_one(F.col("body"), "identifier").alias("entity"), day("instant"), day("startDate"), day("endDate"), F.array_sort(members).alias("members"))
    found = _last(rows, keep, "context", value)
    return found.select(*keep, "context", "v.entity", "v.instant", F.col("v.startDate").alias("start"), F.col("v.endDate").alias("end"), "v.members")


def units(pages: DataFrame, keep: list[str], html: str) -> DataFrame:
    """Each unit: its id, ``measures`` and, of a ratio, the ``per`` measures, sorted. Of an id that comes twice the last counts."""
    rows = _elements(pages, keep, F.col(html), "unit").withColumn("unit", _attribute(F.col("tag"), "id"))
    below = F.coalesce(_one(F.col("body"), "unitDenominator"), F.lit(""))
    above = F.coalesce(_one(F.col("body"), "unitNumerator"), F.when(below == "", F.col("body")), F.lit(""))
    measures = lambda x: F.array_sort(F.regexp_extract_all(x, F.lit(rf"<{_P}measure\b[^>]*>\s*([^<]*?)\s*<"), F.lit(1)))
    return _last(rows, keep, "unit", F.struct(measures(above).alias("measures"), measures(below).alias("per"))).select(*keep, "unit", "v.*")


def plain_number(shown: Column) -> Column:
    """What a fact shows without brackets around it, blanks and signs of currency."""
    return F.regexp_replace(F.regexp_replace(shown, r"^\((.*)\)$", "$1"), r"[\s\x{a0}$€£¥]", "")


def shown_number(shown: Column, form: Column, bare: Column | None = None) -> Column:
    """The size of a number as a fact shows it, by its format; null for text that the format does not read, or an unknown format.
    ``bare`` is its ``plain_number``, if a column has that already."""
    form = F.lower(F.coalesce(form, F.lit("")))
    bare = plain_number(shown) if bare is None else bare
    words = F.array(*map(F.lit, NUMBER_WORDS))
    spelled = F.regexp_replace(F.lower(shown), "[^a-z]", "")
    said = F.when(spelled.isin(*NO_WORDS), 0).otherwise(F.nullif(F.array_position(words, spelled), F.lit(0)) - 1)
    comma = F.when(bare.rlike(r"^[0-9][0-9.]*(,[0-9]+)?$"), F.translate(F.replace(bare, F.lit("."), F.lit("")), ",", "."))
    point = F.when(bare.rlike(r"^[0-9,']*(\.[0-9]+)?$") & bare.rlike("[0-9]"), F.regexp_replace(bare, "[,']", ""))
    dotted = form.isin("", "num-dot-decimal", "numdotdecimal", "num-dot-decimal-apos", "numcommadot")
    read = F.when(form.isin(*COMMA_FORMATS), comma).when(dotted, point)
    return F.when(form.isin(*ZERO_FORMATS), 0.0).when(form.isin(*WORD_FORMATS), said.cast("double")).otherwise(read.try_cast("double"))


def facts(pages: DataFrame, keep: list[str], html: str) -> DataFrame:
    """Each inline numeric fact with its period and unit: concept, context, unit, value, decimals, entity, instant, start, end,
    members, measures, per; and ``problem``, why a fact has no value: nil, no context, or no number.

    ``keep`` tells pages apart. Facts, contexts and units are short rows that meet by page and id; pages are not shuffled.
    Tags inside a fact are left out of what it shows; of facts inside one another the innermost is read. Null and empty
    pages have no facts.
    """
    inner = r"(?is)<ix:nonFraction\b([^>]*)(?<!/)>((?:(?!</?ix:nonFraction\b).)*)</ix:nonFraction\s*>"
    single = r"(?is)<ix:nonFraction\b([^>]*)/>"
    found = F.concat(each_match(F.col(html), inner, 2), F.transform(F.regexp_extract_all(F.col(html), F.lit(single), F.lit(1)), lambda tag: F.array(tag, F.lit(None))))
    rows = pages.select(*keep, F.explode(found).alias("m")).select(*keep, F.col("m")[0].alias("tag"), F.col("m")[1].alias("body"))
    # in steps, as an expression that another uses in several places would be worked out at each of them
    tag = F.col("tag")
    shown = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("body", r"(?is)<ix:exclude\b.*?</ix:exclude\s*>", ""), "<[^>]*>", ""), r"(?:\s|&nbsp;|&#160;)+", " "))
    told = {"concept": "name", "context": "contextRef", "unit": "unitRef", "decimals": "decimals", "_scale": "scale", "_sign": "sign", "_no": "xsi:nil", "_format": "format"}
    rows = rows.select(*keep, *[_attribute(tag, name).alias(c) for c, name in told.items()], shown.alias("_shown"), F.col("body").isNull().alias("_bare"))
    rows = rows.withColumns({"_format": F.lower(F.regexp_replace("_format", "^[^:]*:", "")), "_plain": plain_number(F.col("_shown"))})
    rows = rows.withColumn("_size", shown_number(F.col("_shown"), F.col("_format"), F.col("_plain")))
    value = F.col("_size") * F.pow(F.lit(10.0), F.coalesce(F.col("_scale").try_cast("int"), F.lit(0)))
    rows = rows.withColumn("value", value)
    value = F.when((F.col("_sign") == "-") & (F.col("value") != 0), -F.col("value")).otherwise(F.col("value"))
    nil = F.col("_bare") | F.coalesce(F.lower("_no") == "true", F.lit(False))
    rows = rows.select(*keep, "concept", "context", "unit", "decimals", value.alias("value"), nil.alias("_nil"))
    rows = _meet(rows, contexts(pages, keep, html).withColumn("_known", F.lit(True)), keep, "context")
    rows = _meet(rows, units(pages, keep, html), keep, "unit")
    problem = F.when(F.col("_nil"), "nil").when(F.col("_known").isNull(), "no context").when(F.col("value").isNull(), "no number")
    rows = rows.withColumn("problem", problem).withColumn("value", F.when(F.col("problem").isNull(), F.col("value")))
    return rows.select(*keep, "concept", "context", "unit", "value", "decimals", "entity", "instant", "start", "end", "members", "measures", "per", "problem")


def _meet(rows: DataFrame, others: DataFrame, keep: list[str], key: str) -> DataFrame:
    """Left join on page and id, null page keys being equal."""
    right = others.select(*[F.col(c).alias(f"_{c}") for c in [*keep, key]], *[c for c in others.columns if c not in (*keep, key)])
    same = F.col(key) == F.col(f"_{key}")
    for c in keep:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(right, same, "left").drop(*[f"_{c}" for c in [*keep, key]])


def presented(files: DataFrame, keep: list[str], xml: str) -> DataFrame:
    """Each place at which a presentation shows a concept: role, label, concept (as facts name it), its parent's label, root and
    depth in the role's tree, and whether the role is a face statement by its definition.

    Links of one role are one tree. A label without an arc is a root of its own; see ``tree_places`` for rings. ``definition``
    is null, and ``statement`` false, where the file does not define the role.
    """
    links = _elements(files, keep, F.col(xml), "presentationLink").select(*keep, F.coalesce(_attribute(F.col("tag"), "xlink:role"), F.lit("")).alias("role"), "body")
    tags = lambda name: links.select(*keep, "role", F.explode(F.regexp_extract_all("body", F.lit(rf"<{_P}{name}\b([^>]*)>"), F.lit(1))).alias("t"))
    named = F.substring_index(_attribute(F.col("t"), "xlink:href"), "#", -1)
    locs = tags("loc").select(*keep, "role", _attribute(F.col("t"), "xlink:label").alias("label"), F.regexp_replace(named, "^([^_]*)_", "$1:").alias("concept"))
    locs = locs.groupBy(*keep, "role", "label").agg(F.min("concept").alias("concept"))
    arcs = tags("presentationArc").select(*keep, "role", _attribute(F.col("t"), "xlink:to").alias("label"), _attribute(F.col("t"), "xlink:from").alias("parent"))
    arcs = arcs.groupBy(*keep, "role", "label").agg(F.min("parent").alias("parent"))
    nodes = _meet(locs, arcs, [*keep, "role"], "label")
    placed = tree_places(nodes, [*keep, "role"], "label", "parent")
    roles = _elements(files, keep, F.col(xml), "roleType").select(*keep, "at", _attribute(F.col("tag"), "roleURI").alias("role"), _one(F.col("body"), "definition").alias("d"))
    roles = roles.where("role is not null").groupBy(*keep, "role").agg(F.min_by("d", "at").alias("definition"))
    out = _meet(_meet(nodes, placed, [*keep, "role"], "label"), roles, keep, "role")
    return out.withColumn("statement", F.coalesce(F.col("definition").rlike(STATEMENT) & ~F.col("definition").rlike(ASIDE), F.lit(False)))


def concept_roles(places: DataFrame, keep: list[str]) -> DataFrame:
    """Per concept the set of roles that show it, the face statements among them, and its least depth."""
    roles = lambda ok: F.array_sort(F.collect_set(F.when(ok, F.col("role"))))
    return places.where("concept is not null").groupBy(*keep, "concept").agg(roles(F.lit(True)).alias("roles"), roles(F.col("statement")).alias("statements"), F.min("depth").alias("depth"))


def stated_facts(found: DataFrame, places: DataFrame, keep: list[str]) -> DataFrame:
    """Facts with the roles that show their concepts; no roles, nor depth, where none does."""
    out = _meet(found, concept_roles(places, keep), keep, "concept")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("roles", "statements")})
