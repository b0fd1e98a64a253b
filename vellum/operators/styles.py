"""Style analysis: inheritance, usage statistics, and the ladder of rules that says what a style means."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import normal_space

FORMATS = {
    "font_family": "string", "font_size": "double", "bold": "boolean", "italic": "boolean", "outline_level": "int", "space_before": "double",
    "space_after": "double", "indent_left": "double", "indent_right": "double", "indent_first": "double", "numbering": "string",
}

# Words for "heading" in style names, beginnings of captions, and names of other meanings.
HEADING_WORDS = "heading kop uberschrift titre titulo titolo naglowek rubrik nadpis otsikko naslov cim fejezet cabecera virsraksts pavadinimas".split()
CAPTION_STARTS = "figure fig photo image table figuur afbeelding foto tabel".split()
ALIASES = {
    "title": (
        "title", "titel", "titre", "titulo", "titolo", "tytul", "naslov", "nadpis", "cim", "titlu", "baslik", "teideal", "virsraksts", "pavadinimas",
        "otsikko", "rubrik", "titill", "tiotal", "titull", "titulli",
    ),
    "subtitle": (
        "subtitle", "untertitel", "sous titre", "subtitulo", "sottotitolo", "podtytul", "podnaslov", "podnadpis", "subtitlu", "alt baslik",
        "alaotsikko", "underrubrik",
    ),
    "caption": (
        "caption", "bijschrift", "legende", "leyenda", "didascalia", "podpis", "popisek", "billedtekst", "kuvateksti", "bildtext", "felirat", "legenda",
    ),
    "blockquote": (
        "quote", "quotation", "blockquote", "zitat", "citat", "citation", "citazione", "citacao", "cytat", "citace", "citaat", "lainaus", "citatet", "citatul",
    ),
}


def _plain_letters() -> tuple[str, str]:
    """Characters that are an ASCII letter or digit with marks, and those letters and digits."""
    marked, bare = [], []
    for c in map(chr, range(0x80, 0x10000)):
        apart = unicodedata.normalize("NFD", c)
        if apart[0].isascii() and apart[0].isalnum() and all("\u0300" <= x <= "\u036f" for x in apart[1:]):
            marked.append(c)
            bare.append(apart[0])
    return "".join(marked), "".join(bare)


_MARKED, _BARE = _plain_letters()


def normal_name(name: Column) -> Column:
    """Lower-case ASCII words of a name; letters with marks lose them, composed or not."""
    bare = F.regexp_replace(F.translate(name, _MARKED, _BARE), "[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def let(value: Column, body) -> Column:
    """`body(value)`, with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def effective(styles: Column) -> Column:
    """Formats of each style of an array of styles (style_id, based_on, FORMATS) with those that it inherits.

    A style's own value wins over its parent's, field by field; a missing parent ends the chain, and so does a cycle, as what
    it could add is there already. All chains become half as long in each step, so that there is no limit on their length
    and no row of its own for a style.
    """
    ids = F.transform(styles, lambda s: s["style_id"])

    def parent(s: Column) -> Column:  # the last style of that name
        return let(F.array_position(F.reverse(ids), s["based_on"]), lambda at: F.when(at > 0, F.size(ids) - at + 1).otherwise(0).cast("int"))

    fields = lambda get: [get(c).alias(c) for c in FORMATS]
    start = F.transform(styles, lambda s: F.struct(F.coalesce(parent(s), F.lit(0)).alias("up"), *fields(lambda c: s[c])))

    def halve(held: Column, _: Column) -> Column:
        def merged(s: Column) -> Column:
            return let(F.try_element_at(held, F.nullif(s["up"], F.lit(0))), lambda p: F.struct(F.coalesce(p["up"], F.lit(0)).alias("up"), *fields(lambda c: F.coalesce(s[c], p[c]))))

        return F.transform(held, merged)

    rounds = F.ceil(F.log2(F.greatest(F.size(styles), F.lit(1)) + 1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), rounds), start, halve, lambda held: F.transform(held, lambda s: F.struct(*fields(lambda c: s[c]))))


def effective_formats(styles: DataFrame) -> DataFrame:
    """Formats of each style with those it inherits: (doc_id, style_id, FORMATS). A document's styles meet in one row."""
    held = styles.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("style_id", "based_on", *FORMATS))).alias("styles"))
    rows = held.select("doc_id", F.explode(F.arrays_zip("styles", effective(F.col("styles")).alias("formats"))).alias("x"))
    return rows.select("doc_id", "x.styles.style_id", "x.formats.*")


#: How a text must begin to be a caption: letters and digits of ASCII count, and so may all beyond it.
_LIKE_CAPTION = rf"^[\x00-/:-@\[-`{{-\x7f]*([^\x00-\x7f]|[{''.join(sorted({c for w in CAPTION_STARTS for c in (w[0], w[0].upper())}))}][^\x00-\x7f]|(?i:{'|'.join(sorted({w[:2] for w in CAPTION_STARTS}))}))"


def is_caption(text: Column) -> Column:
    """Whether a text begins with a word of captions. Few texts begin alike, so few are normalised."""
    return text.rlike(_LIKE_CAPTION) & normal_name(text).rlike(rf"^({'|'.join(CAPTION_STARTS)})\b")


def usage_statistics(usages: DataFrame, by: list[str]) -> DataFrame:
    """Counts and flags of each style: usages, first position, whether all are short, all bold, all spaced, some numbered, some
    nearby a figure or table, some like a caption; null texts count as empty."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return usages.groupBy(*by).agg(
        F.count("*").alias("usages"),
        F.min("position").alias("first_position"),
        F.bool_and(F.length(text) <= 100).alias("short"),
        F.bool_and(F.coalesce("bold", F.lit(False))).alias("bold_text"),
        F.bool_and(F.coalesce("space_before", F.lit(0.0)) > 0).alias("spaced_text"),
        F.bool_or(F.coalesce("numbered", F.lit(False))).alias("numbered_text"),
        F.bool_or(F.col("nearby").isNotNull()).alias("near_figure"),
        F.bool_or(is_caption(text)).alias("caption_text"),
        F.max("font_size").alias("most_size"),
    )


def examples(usages: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """The first k distinct texts of each style by position, empty ones left out: (by.., examples).

    Distinct texts are found before anything is ranked, and the rank limit applies in each task first.
    """
    first = usages.withColumn("text", F.trim("text")).filter("text <> ''").groupBy(*by, "text").agg(F.min("position").alias("at"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("at", "text"))).filter(F.col("n") <= k)
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("examples"))


def meaning(get) -> Column:
    """(mapping, confidence, evidence) of a style: the first rule that fits decides.

    `get` names the columns or fields: formats with what is inherited, what usage_statistics() gives, style_id, name, kind,
    based_on, toc_level (its level in a table of contents), document_size (the document's largest), user_mapping and
    preset_mapping.
    """
    none = lambda c, value: F.coalesce(get(c), F.lit(value))
    heading = lambda level: F.concat(F.lit("heading"), F.least(F.greatest(level, F.lit(1)), F.lit(6)).cast("string"))
    built_in = lambda c: F.regexp_extract(F.lower(none(c, "")), "^(?:heading|headingchar)([1-6])$", 1)
    paragraph, used = get("kind") == "paragraph", none("usages", 0) > 0
    near, short = none("near_figure", False), used & none("short", False)

    def found(name: Column) -> Column:
        by_name = F.regexp_extract(name, rf"(?:{'|'.join(HEADING_WORDS)})[ ]*([1-6])", 1)
        caption_name = F.replace(name, F.lit(" "), F.lit("")).rlike("|".join(x.replace(" ", "") for x in ALIASES["caption"]))
        title_like = paragraph & (get("usages") == 1) & (get("first_position") <= 2) & short & (get("most_size") >= 32) & (get("most_size") == get("document_size"))
        bold = none("bold", False) | (used & none("bold_text", False))
        spaced = (none("space_before", 0.0) > 0) | (used & none("spaced_text", False))
        ladder = [
            (get("user_mapping").isNotNull(), get("user_mapping"), "certain", "user-mappings"),
            (get("preset_mapping").isNotNull(), get("preset_mapping"), "certain", "mapping-preset"),
            (get("outline_level").between(0, 5), heading(get("outline_level") + 1), "certain", "outline-level"),
            (built_in("style_id") != "", F.concat(F.lit("heading"), built_in("style_id")), "high", "style-id"),
            (get("toc_level").isNotNull(), heading(get("toc_level") + 1), "high", "table-of-contents"),
            (by_name != "", F.concat(F.lit("heading"), by_name), "medium", "localized-style-aliases"),
            (title_like, F.lit("title"), "high", "typographic-structural-analysis"),
            (caption_name | (paragraph & near), F.lit("caption"), "high", "caption-context-analysis"),
            (none("caption_text", False), F.lit("caption"), "medium", "caption-context-analysis"),
            *[(name.isin(*names), F.lit(to), "medium", "localized-style-aliases") for to, names in ALIASES.items()],
            (built_in("based_on") != "", F.concat(F.lit("heading"), built_in("based_on")), "medium", "style-inheritance"),
            (short & bold & (spaced | none("numbered_text", False)), F.lit("heading1"), "low", "typographic-structural-analysis"),
        ]
        row = lambda mapping, confidence, evidence: F.struct(mapping.alias("mapping"), F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence"))
        fallback = row(F.lit("body"), "medium", "plain-paragraph-fallback")
        return reduce(lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), row(*rule[1:])).otherwise(rest), reversed(ladder), fallback)

    return let(normal_name(none("name", "")), found)


def classify(styles: DataFrame) -> DataFrame:
    """Adds mapping, confidence and evidence to rows with the columns that meaning() reads."""
    return styles.withColumn("_found", meaning(F.col)).select(*styles.columns, "_found.*")


def analysed(styles: Column, usages: Column, user: dict[str, str] | None = None, preset: dict[str, str] | None = None) -> Column:
    """The styles of a document that are used, by id, with their formats, use and meaning, all within the document's row.

    `styles` and `usages` are arrays of rows as the reader gives them. A usage belongs to the style of its id and kind; `user`
    and `preset` map ids to meanings.
    """
    chosen = lambda of: F.create_map(*[F.lit(x) for pair in of.items() for x in pair]) if of else F.create_map().cast("map<string,string>")
    fields = ("style_id", "name", "kind", "based_on")
    whole = F.zip_with(styles, effective(styles), lambda s, f: F.struct(*[s[c].alias(c) for c in fields], *[f[c].alias(c) for c in FORMATS]))
    used = F.array_distinct(F.transform(usages, lambda u: u["style_id"]))

    def judged(held: Column) -> Column:
        by_id = F.map_from_entries(F.transform(F.array_distinct(F.transform(held, lambda s: s["style_id"])), lambda i: F.struct(i, F.element_at(F.filter(held, lambda s: s["style_id"] == i), -1)["font_size"])))
        sizes = let(by_id, lambda m: F.transform(F.filter(usages, lambda u: u["kind"] == "paragraph"), lambda u: F.coalesce(u["font_size"], F.try_element_at(m, u["style_id"]))))

        def one(s: Column, largest: Column) -> Column:
            def told(mine: Column) -> Column:
                text = lambda u: F.trim(F.coalesce(u["text"], F.lit("")))
                stats = {
                    "usages": F.size(mine), "first_position": F.array_min(F.transform(mine, lambda u: u["position"])), "short": F.forall(mine, lambda u: F.length(text(u)) <= 100),
                    "bold_text": F.forall(mine, lambda u: F.coalesce(u["bold"], F.lit(False))), "spaced_text": F.forall(mine, lambda u: F.coalesce(u["space_before"], F.lit(0.0)) > 0),
                    "numbered_text": F.exists(mine, lambda u: F.coalesce(u["numbered"], F.lit(False))), "near_figure": F.exists(mine, lambda u: u["nearby"].isNotNull()),
                    "caption_text": F.exists(mine, lambda u: is_caption(text(u))), "most_size": F.array_max(F.transform(mine, lambda u: F.coalesce(u["font_size"], s["font_size"]))),
                    "document_size": largest, "toc_level": F.lit(None).cast("int"),
                    "user_mapping": F.try_element_at(chosen(user), s["style_id"]), "preset_mapping": F.try_element_at(chosen(preset), s["style_id"]),
                }
                kept = F.slice(F.array_distinct(F.filter(F.transform(mine, text), lambda t: t != "")), 1, 3)
                found = lambda m: F.struct(*[s[c].alias(c) for c in (*fields, *FORMATS)], F.size(mine).cast("long").alias("usages"), kept.alias("examples"), *[m[c].alias(c) for c in ("mapping", "confidence", "evidence")])
                return let(meaning(lambda c: stats[c] if c in stats else s[c]), found)

            return let(F.filter(usages, lambda u: (u["style_id"] == s["style_id"]) & (u["kind"] == s["kind"])), told)

        return let(F.array_max(sizes), lambda largest: F.transform(F.filter(held, lambda s: F.array_contains(used, s["style_id"])), lambda s: one(s, largest)))

    return F.array_sort(let(whole, judged))


def meanings(styles: Column) -> Column:
    """style id -> meaning of analysed() styles. A paragraph style comes before a character style of the same id, and of
    styles equal in both the last one."""
    ids = F.array_distinct(F.transform(styles, lambda s: s["style_id"]))

    def of(i: Column) -> Column:
        own = lambda *kinds: F.try_element_at(F.filter(styles, lambda s: (s["style_id"] == i) & s["kind"].isin(*kinds)), F.lit(-1))["mapping"]
        return F.struct(i, F.coalesce(own("paragraph"), own("character")))

    return F.map_from_entries(F.transform(ids, of))


def heading_level(mapping: Column, level: Column) -> Column:
    """Level of a block under a mapping: title is 1, headingN is N + 1 up to 6, others keep what they have."""
    n = F.regexp_extract(mapping, "^heading([1-6])$", 1)
    return F.when(mapping == "title", 1).when(n != "", F.least(n.cast("int") + 1, F.lit(6))).otherwise(level)


def accept_confident(proposals: DataFrame, chosen: DataFrame) -> DataFrame:
    """(style_id, mapping): what was chosen, and proposals of high or certain confidence for other styles."""
    sure = proposals.filter(F.col("confidence").isin("high", "certain"))
    return chosen.select("style_id", "mapping").unionByName(sure.join(chosen, "style_id", "left_anti").select("style_id", "mapping"))


def line_usages(lines: DataFrame) -> DataFrame:
    """Lines of plain text as style usages. Their style is what they look like: shout, list, short or text."""
    text = normal_space(F.col("text"))
    style = (
        F.when((F.upper(text) == text) & (F.lower(text) != text), "shout")
        .when(text.rlike(r"^([-*•]|[0-9]+[.)]) "), "item")
        .when(F.length(text) <= 40, "short")
        .otherwise("text")
    )
    return lines.select(
        "doc_id", F.col("ord").alias("position"), style.alias("style_id"), text.alias("text"),
        (style == "shout").alias("bold"), F.lit(None).cast("double").alias("space_before"), (style == "item").alias("numbered"), F.lit(None).cast("string").alias("nearby"),
        F.when(style == "shout", 32.0).when(style == "short", 16.0).otherwise(11.0).alias("font_size"),
    )
