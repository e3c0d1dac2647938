"""Queries of scalar functions: texts, paths, JSON, projections and design arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import design, text

from .analytics import Tables, query


@query(r"""select doc_id, md5(regexp_replace(lower(text), '[\p{P}\p{S}\s]', '', 'g')) as compacted, case when length(text) > 80 then left(text, 79) || '…' else text end as short, contains(lower(text), 'the') as has_the,
 md5(array_to_string(list_sort(list_distinct(list_filter((case when length(h) <= 240 then [h] else [] end) || regexp_split_to_array(h, '[\s,，。；;、:：!?！？()\[\]{}"''“”‘’]+'), lambda x: length(x) > 0 and length(x) <= 240)))[1:200], '|')) as terms,
 'doc:' || substr(sha256(source || chr(0) || text), 1, 32) as stable_id
 from (select *, lower(text) as h from documents) where text is not null""")
def text_forms(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null")
    low = F.lower("text")
    return d.select(
        "doc_id", F.md5(text.compact(low)).alias("compacted"), text.truncated(F.col("text"), 80).alias("short"), text.contains_folded(F.col("text"), F.lit("THE")).alias("has_the"),
        F.md5(F.array_join(text.terms(low), "|")).alias("terms"), text.stable_id("doc:", F.col("source"), F.col("text")).alias("stable_id"),
    )


@query("select item_id, cast(len(list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？\\n]+'), lambda s: trim(s)), lambda s: s <> '')) as int) as sentences, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？\\n]+'), lambda s: trim(s)), lambda s: s <> ''), '|')) as body, lpad(cast(item_id as varchar), 6, '0') as padded, rtrim(replace(replace(base64(encode(text)), '+', '-'), '/', '_'), '=') as opaque, text as back from benchmark where text is not null")
def sentence_and_cursor_forms(t: Tables) -> DataFrame:
    s = text.sentences(F.col("text"))
    opaque = text.base64url(F.col("text"))
    return t.benchmark.where("text is not null").select(
        "item_id", F.size(s).alias("sentences"), F.md5(F.array_join(s, "|")).alias("body"), F.lpad(F.col("item_id").cast("string"), 6, "0").alias("padded"), opaque.alias("opaque"), text.from_base64url(opaque).alias("back")
    )


_PATH = "regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?://', '')"


@query(f"with p as (select page_id, {_PATH} as p from pages where url is not null), f as (select *, case when contains(p, '/') then regexp_replace(p, '/[^/]*$', '') else '' end as folder from p) select page_id, folder, split_part(p, '/', -1) as name, case when folder = '' then 'index.html' else folder || '/index.html' end as sibling, case when folder = '' then '../top' when contains(folder, '/') then regexp_replace(folder, '/[^/]*$', '') || '/top' else 'top' end as above from f")
def url_paths(t: Tables) -> DataFrame:
    """Folders, names and resolved relative paths of all pages."""
    path = F.regexp_replace(F.substring_index(F.substring_index("url", "?", 1), "#", 1), "^https?://", "")
    p = t.pages.where("url is not null").select("page_id", path.alias("p"))
    folder = text.dirname(F.col("p"))
    return p.select("page_id", folder.alias("folder"), text.basename(F.col("p")).alias("name"), text.joined_path(folder, F.lit("./index.html")).alias("sibling"), text.joined_path(folder, F.lit("../top")).alias("above"))


@query("select event_id, case event_id % 3 when 0 then 'see [本地文件]/' || event_type || ' one.mov or \"[本地文件]/b.PNG\"' when 1 then 'keep E:/' || event_type || '/none at all' else '[本地文件]/' || user_id || '.txt [本地文件]/' || event_type || '.tox' end as shown from events")
def local_paths_hidden(t: Tables) -> DataFrame:
    """Folders of one's own disk, with blanks in their names too; paths without a known ending stay."""
    m, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    one = F.concat(F.lit("see C:\\Users\\Jane "), user, F.lit("\\"), "event_type", F.lit(' one.mov or "D:/a b/b.PNG"'))
    two = F.concat(F.lit("keep E:/"), "event_type", F.lit("/none at all"))
    three = F.concat(F.lit("C:\\"), user, F.lit(".txt f:\\x y\\z/"), "event_type", F.lit(".tox"))
    return t.events.select("event_id", text.without_local_paths(F.when(m == 0, one).when(m == 1, two).otherwise(three)).alias("shown"))


_RAW_JSON_SQL = "case event_id % 4 when 0 then props when 1 then '{\"z\": [1, 2], \"k\": {\"y\": true, \"b\": ' || user_id || '}, \"a\": null}' when 2 then '{\"k\": ' || user_id else '[1, ' || user_id || ', \"x\"]' end"
_CANON_SQL = "case event_id % 4 when 0 then replace(props, ' ', '') when 1 then '{\"a\":null,\"k\":{\"b\":' || user_id || ',\"y\":true},\"z\":[1,2]}' when 3 then '[1,' || user_id || ',\"x\"]' end"


@query(f"select event_id, json_valid(raw) as valid, case when json_valid(raw) then lower(json_type(raw)) end as kind, canonical, sha256(canonical) as revision from (select event_id, {_RAW_JSON_SQL} as raw, {_CANON_SQL} as canonical from events)")
def json_contracts(t: Tables) -> DataFrame:
    """Validity, outer type, the form with sorted keys and its digest, of whole, open and broken JSON."""
    user = F.col("user_id").cast("string")
    m = F.col("event_id") % 4
    raw = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit('{"z": [1, 2], "k": {"y": true, "b": '), user, F.lit('}, "a": null}'))).when(m == 2, F.concat(F.lit('{"k": '), user)).otherwise(F.concat(F.lit("[1, "), user, F.lit(', "x"]')))
    v = t.events.select("event_id", raw.alias("raw")).withColumn("v", F.try_parse_json("raw"))
    kind = F.when(F.col("v").isNull(), None).when(F.substring(F.ltrim("raw"), 1, 1) == "{", "object").otherwise("array")
    return v.select("event_id", F.col("v").isNotNull().alias("valid"), kind.alias("kind"), text.canonical_json(F.col("raw")).alias("canonical")).withColumn("revision", F.sha2("canonical", 256))


#: One text for each way in which a place may show; none is let through.
_PLACED = ("http://h ", "on 10.0.0.7 ", "file:x ", "candidate:5 ", '"C:\\x\\y" ', "at \\\\box\\s ", "(/srv/a/b) ", "127.0.0.1 ", "172.20.1.1 ", "169.254.0.9 ", "nas.local ", "ＬＯＣＡＬＨＯＳＴ ")


@query(f"select item_id, case when item_id % {len(_PLACED) + 2} >= {len(_PLACED)} and length(f) > 0 then trim(left(case item_id % {len(_PLACED) + 2} when {len(_PLACED)} then f else 'profile: A/B ' || f end, 60)) end as shown, case item_id % 3 when 0 then 'plain,' || trim(left(f, 80)) else 'plain' end as tags from (select item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as f from benchmark where text is not null)")
def student_projection(t: Tables) -> DataFrame:
    """Texts shown only if no private locator is in them, and lists of which only safe items stay."""
    kind, m = F.col("item_id") % (len(_PLACED) + 2), F.col("item_id") % 3
    place = F.element_at(F.array(*map(F.lit, (*_PLACED, "", "profile: A／B "))), (kind + 1).cast("int"))
    tags = F.array(F.lit("plain"), F.when(m == 0, F.col("text")).otherwise("file:///x/y"), F.lit("plain"))
    return t.benchmark.where("text is not null").select("item_id", text.safe_text(F.concat(place, "text"), 60).alias("shown"), F.array_join(text.safe_list(tags, 5), ",").alias("tags"))


@query("select p_partkey, cast(p_size as varchar) || '/' || p_brand as kept from part")
def struct_without_field(t: Tables) -> DataFrame:
    row = F.struct("p_size", "p_brand", F.sha2("p_name", 256).alias("signature")).dropFields("signature")
    return t.part.select("p_partkey", row.alias("r")).select("p_partkey", F.concat_ws("/", *[F.col("r.p_size"), F.col("r.p_brand")]).alias("kept"))


# Design arithmetic on part sizes.


@query("with g as (select p_partkey, 700.0 - p_size as w, 1000.0 - 2 * p_size as h, 2.5 as gx, 1.25 as gy, 1 + p_partkey % 5 as nx, 1 + p_partkey % 7 as ny from part) select p_partkey, cast(w as double) as usable_w, cast(h as double) as usable_h, nx * ny as pieces, cast(round(gx * (nx - 1), 6) as double) as gaps_w, cast(round(gy * (ny - 1), 6) as double) as gaps_h, round(cast((w - gx * (nx - 1)) as double) / nx, 6) as piece_w, round(cast((h - gy * (ny - 1)) as double) / ny, 6) as piece_h from g")
def cut_grid(t: Tables) -> DataFrame:
    n = F.col("p_partkey")
    g = design.cut_grid(F.lit(700.0), F.lit(1000.0), F.col("p_size").cast("double"), F.col("p_size") * 2.0, F.lit(2.5), F.lit(1.25), 1 + n % 5, 1 + n % 7)
    return t.part.select("p_partkey", g.alias("g")).select("p_partkey", "g.usable_w", "g.usable_h", "g.pieces", "g.gaps_w", "g.gaps_h", F.round("g.piece_w", 6).alias("piece_w"), F.round("g.piece_h", 6).alias("piece_h"))


@query("select l_orderkey, l_linenumber, round(30000.0::double / 1001, 6) as fps, round(cast(l_quantity as bigint) * 1001::double / 30000, 6) as seconds, round(1000::double * 1001 / 30000, 6) as frame_ms from lineitem")
def frames_to_duration(t: Tables) -> DataFrame:
    d = design.frames_to_seconds(F.col("l_quantity").cast("long"), F.lit(30000.0), F.lit(1001))
    return t.lineitem.select("l_orderkey", "l_linenumber", d.alias("d")).select("l_orderkey", "l_linenumber", "d.*")


@query("with i as (select p_partkey, 1920::double as w, 1080::double as h, (300 + p_size * 17)::double as target, p_partkey % 2 = 0 as by_w from part), s as (select *, case when by_w then target / w else target / h end as scale from i), o as (select *, greatest(8, floor((case when by_w then h * scale else w * scale end) / 8 + 0.5) * 8) as side from s), r as (select *, case when by_w then target else side end as ow, case when by_w then side else target end as oh from o) select p_partkey, cast(ow as bigint) as w, cast(oh as bigint) as h, round(scale, 6) as scale, round(abs(ow / oh - 1920::double / 1080) / (1920::double / 1080) * 100, 6) as error_percent, round(ow * oh / 1000000, 6) as megapixels from r")
def resolution_scale(t: Tables) -> DataFrame:
    s = design.scaled(F.lit(1920.0), F.lit(1080.0), (300 + F.col("p_size") * 17).cast("double"), F.col("p_partkey") % 2 == 0, F.lit(8.0))
    return t.part.select("p_partkey", s.alias("s")).select("p_partkey", "s.*")


@query("""with c as (select p_partkey, p_partkey % 6 as kind, p_size::double as s, 1 + p_partkey % 24 as n, p_partkey % 7 as m from part),
 f as (select p_partkey, kind, case kind
   when 0 then [case when 100 + 3 * s - 8 * s <= 0 then 'margins' end, case when 400 - 8 * s - 16 * (n - 1) <= 0 then 'columns' end]
   when 1 then [case when 60 - 2 * s <= 0 then 'edgeMarginMm' end, case when 80 - 2 * s <= 0 then 'edgeMarginMm' end]
   when 2 then [case when 300 - 2 * s - 12 * (n - 1) <= 0 then 'horizontalGapMm' end, case when 200 - s - 30 * m <= 0 then 'verticalGapMm' end]
   when 3 then [case when 24000 / (n * 1000 * m * m + 0.5) not between 0.001 and 1000 then 'frameRate' end]
   when 4 then [case when 30 * s * s / n not between 0.001 and 1000 then 'frameRate' end]
   else [case when 4000 * (s * s * 60 / 1000) not between 1 and 100000 or greatest(8, floor(4000 * (s * s * 60 / 1000) / 8 + 0.5) * 8) > 100000 then 'targetValue' end] end as faults from c)
 select p_partkey, cast(kind as int) as kind, array_to_string(list_filter(faults, lambda x: x is not null), ',') as faults from f""")
def calculation_faults(t: Tables) -> DataFrame:
    """What is wrong with the input of six kinds of calculations, one kind for each sixth of the parts."""
    c = lambda x: F.lit(float(x))
    s, n, m = F.col("p_size").cast("double"), 1 + F.col("p_partkey") % 24, F.col("p_partkey") % 7
    kinds = [
        design.layout_faults(c(400), 100 + 3 * s, 4 * s, 4 * s, 4 * s, 4 * s, c(16), n), design.yield_faults(c(60), c(80), s), design.cut_faults(c(300), c(200), s, s, s, c(0), c(12), c(30), n, m + 1),
        design.rate_faults(c(24000), n * 1000 * m * m + 0.5), design.rate_faults(30 * s * s, n.cast("double")), design.scale_faults(c(1000), c(4000), s * s * 60, F.lit(True), c(8)),
    ]
    kind = (F.col("p_partkey") % 6).cast("int")
    return t.part.select("p_partkey", kind.alias("kind"), F.array_join(F.element_at(F.array(*kinds), kind + 1), ",").alias("faults"))


@query("with l as (select p_partkey, 100 + (p_partkey * 97) % 900 as page_w, 100 + p_size * 3 as page_h, p_size * 4 as margin, 16 as gutter, 1 + p_partkey % 24 as n from part) select p_partkey, page_w - 2 * margin as content_w, page_h - 2 * margin as content_h, gutter * (n - 1) as gutters, array_to_string(list_filter([case when page_h - 2 * margin <= 0 then 'margins' end, case when page_w - 2 * margin - gutter * (n - 1) <= 0 then 'columns' end], lambda x: x is not null), ',') as faults, round(case when page_h - 2 * margin > 0 and page_w - 2 * margin - gutter * (n - 1) > 0 then (page_w - 2 * margin - gutter * (n - 1))::double / n end, 6) as column_w from l")
def grid_input_faults(t: Tables) -> DataFrame:
    """Page grids with what is wrong with their input; a width only where nothing is."""
    key = F.col("p_partkey")
    l = t.part.select("p_partkey", (100 + key * 97 % 900).alias("w"), (100 + F.col("p_size") * 3).alias("h"), (F.col("p_size") * 4).alias("margin"), (1 + key % 24).alias("n"))
    content_w, content_h, gutters = F.col("w") - 2 * F.col("margin"), F.col("h") - 2 * F.col("margin"), 16 * (F.col("n") - 1)
    faults = F.array_compact(F.array(F.when(content_h <= 0, "margins"), F.when(content_w - gutters <= 0, "columns")))
    width = F.when(F.size(faults) == 0, design.column_width(F.col("w"), F.col("margin"), F.lit(16), F.col("n")))
    return l.select("p_partkey", content_w.alias("content_w"), content_h.alias("content_h"), gutters.alias("gutters"), F.array_join(faults, ",").alias("faults"), F.round(width, 6).alias("column_w"))


_HEX3 = "('#' || substr('0123456789abcdef', 1 + cast(p_size % 16 as int), 1) || substr('fedcba9876543210', 1 + cast(p_partkey % 16 as int), 1) || 'a')"
_LIN = lambda i: f"(case when v{i} <= 0.04045 then v{i} / 12.92 else pow((v{i} + 0.055) / 1.055, 2.4) end)"


@query(f"with c as (select p_partkey, {_HEX3} as short from part), e as (select p_partkey, upper('#' || repeat(short[2], 2) || repeat(short[3], 2) || repeat(short[4], 2)) as colour from c), v as (select *, " + ", ".join(f"cast(('0x' || substr(colour, {2 + 2 * i}, 2)) as integer) / 255.0 as v{i}" for i in range(3)) + f" from e), r as (select p_partkey, colour, 1.05 / (0.2126 * {_LIN(0)} + 0.7152 * {_LIN(1)} + 0.0722 * {_LIN(2)} + 0.05) as ratio from v) select p_partkey, colour, ratio >= 4.5 as normal_aa, ratio >= 7 as normal_aaa, ratio >= 3 as large_aa, ratio >= 4.5 as large_aaa, ratio >= 3 as parts_aa from r")
def contrast_levels(t: Tables) -> DataFrame:
    """Short hex colours on white, by the five readability levels."""
    short = F.concat(F.lit("#"), F.substr(F.lit("0123456789abcdef"), 1 + F.col("p_size") % 16, F.lit(1)), F.substr(F.lit("fedcba9876543210"), (1 + F.col("p_partkey") % 16).cast("int"), F.lit(1)), F.lit("a"))
    c = t.part.select("p_partkey", text.hex_colour(short).alias("colour"))
    ratio: Column = design.contrast(F.col("colour"), F.lit("#FFFFFF"))
    return c.select("p_partkey", "colour", *[x.alias(n) for n, x in design.contrast_passes(ratio).items()])


@query("select event_id, timezone('UTC', to_timestamp(epoch(date_trunc('second', ts)))) as moment, cast(epoch(date_trunc('second', ts)) as bigint) as seconds, ts >= timestamp '2024-01-10' as late from events")
def epoch_round_trip(t: Tables) -> DataFrame:
    sec = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    return t.events.select("event_id", F.timestamp_seconds(sec).cast("timestamp_ntz").alias("moment"), sec.alias("seconds"), (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).alias("late"))


@query("select vec_id, round(list_aggregate(list_transform(u, lambda x: x * x), 'sum'), 5) as length, round(u[1], 8) as first_part from (select vec_id, list_transform(embedding::double[], lambda x: round(x / sqrt(list_aggregate(list_transform(embedding::double[], lambda y: y * y), 'sum')), 8)) as u from embeddings) where u is not null")
def unit_vectors(t: Tables) -> DataFrame:
    from tessera.functions import vector

    u = t.embeddings.select("vec_id", vector.unit(F.col("embedding")).alias("u")).where("u is not null")
    return u.select("vec_id", F.round(vector.dot(F.col("u"), F.col("u")), 5).alias("length"), F.round(F.element_at("u", 1), 8).alias("first_part"))
