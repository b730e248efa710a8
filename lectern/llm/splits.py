"""Problem 1: splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import ranked, small, stored

#: Words that stand where no person is named.
NO_AUTHOR = "anon anonymous author authors course department editor editors faculty na nobody none null staff team unknown various"
#: Subjects without meaning.
NO_SUBJECT = "na none null unknown nil tbd untitled misc"
#: Groups of a size band are dealt in rounds of so many.
ROUND = 200


def plain(name: Column) -> Column:
    """Letters and digits of a name in lower case; NULL where none is left."""
    return F.nullif(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", F.lit("")), F.lit(""))


def subject_key(subject: Column) -> Column:
    key = plain(subject)
    return F.when(~key.isin(*NO_SUBJECT.split()), key)


def front_key(doc_id: Column) -> Column:
    """The subject at the front of `subject-number`: a folder before it and an extension, copy mark or version behind it are dropped."""
    name = F.regexp_replace(F.trim(doc_id), r"^.*/", "")
    name = F.regexp_replace(name, r"(\.[A-Za-z]{2,5}|\s*\(\d+\)|[ _.-]*\bv\d+|[ _.-]+v\d+|[ _-]+copy)+\s*$", "")
    number = r"^(.*?)[^\p{L}\p{N}]+\d+$"
    return subject_key(F.when(name.rlike(number), F.regexp_extract(name, number, 1)).otherwise(name))


def author_key(author: Column) -> Column:
    """surname|initial of `Surname, I.`, `I. Surname` and their variants; NULL where nobody is named."""
    name = F.regexp_replace(F.lower(F.trim(author)), r"[.\s]+", " ")
    parts = F.filter(F.split(F.regexp_replace(name, ",", " "), r"\s+"), lambda w: w != "")
    comma = name.contains(",")
    surname = F.when(comma, F.regexp_extract(name, r"^([^,]*),", 1)).when(
        F.length(F.try_element_at(parts, F.lit(-1))) == 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    ).otherwise(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    initial = F.when(comma, F.regexp_extract(name, r",\s*(\p{L})", 1)).when(
        F.length(F.try_element_at(parts, F.lit(-1))) == 1, F.try_element_at(parts, F.lit(-1))
    ).otherwise(F.left(F.try_element_at(parts, F.lit(1)), F.lit(1)))
    surname = plain(surname)
    real = (F.size(parts) >= 2) & (F.size(F.array_intersect(parts, F.array(*map(F.lit, NO_AUTHOR.split())))) == 0)
    return F.when(real & surname.isNotNull() & initial.rlike(r"^\p{L}$"), F.concat_ws("|", surname, initial))


def nodes(specs: DataFrame) -> DataFrame:
    """spec_id with the array of what ties it: its subjects (s:) and its author (a:); a record without any stands alone (r:)."""
    keys = F.array_sort(F.array_distinct(F.array_compact(F.array(
        F.concat(F.lit("s:"), subject_key(F.col("subject"))), F.concat(F.lit("s:"), front_key(F.col("doc_id"))), F.concat(F.lit("a:"), author_key(F.col("author"))),
    ))))
    alone = F.array(F.concat(F.lit("r:"), F.col("spec_id").cast("string")))
    return specs.select("spec_id", keys.alias("k")).withColumn("k", F.when(F.size("k") == 0, alone).otherwise(F.col("k")))


def forest(edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Borůvka contraction of edges(u, v, n): (spanning forest (u, v), root of every node (node, root)), both written tables.

    Each round every component takes its least edge (most records first, then the names), components joined by the taken edges
    become one by pointer jumping, and edges inside a component are dropped, parallel ones merged into the least. Components at
    least halve a round, so all tables shrink; each is written to the shared folder. Self loops and an empty input are fine.
    """
    live = stored(edges.where("u <> v").select("u", "v", F.struct((-F.col("n")).alias("w"), F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).alias("e")), "edges")
    names = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    root = stored(names.withColumn("root", F.col("node")), "roots")
    taken = []
    for _ in range(rounds):
        if live.isEmpty():
            break
        both = live.select(F.col("u").alias("c"), F.col("v").alias("o"), "e").union(live.select("v", "u", "e"))
        best = stored(both.groupBy("c").agg(F.min(F.struct("e", "o")).alias("m")).select("c", F.col("m.e").alias("e"), F.col("m.o").alias("p")), "best")
        taken.append(best.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")))
        other = best.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = best.join(other, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        up, moved = stored(up, "up"), True
        while moved:
            far = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = stored(up.join(far, "p").select("c", "p", "pp"), "jump")
            moved = not jumped.where("p <> pp").isEmpty()
            up = jumped.select("c", F.col("pp").alias("p"))
        hint = small(up, 160)
        root = stored(root.join(hint, root.root == hint.c, "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        a, b = hint.select(F.col("c").alias("u"), F.col("p").alias("pu")), hint.select(F.col("c").alias("v"), F.col("p").alias("pv"))
        moved_edges = live.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("pu", "u").alias("x"), F.coalesce("pv", "v").alias("y"), "e").where("x <> y")
        live = stored(moved_edges.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.min("e").alias("e")), "edges")
    tree = taken[0] if taken else edges.select("u", "v").limit(0)
    for t in taken[1:]:
        tree = tree.union(t)
    return tree.distinct(), root


def tied(specs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ties of every record, spanning forest (u, v), root of every name), all written tables. Rows that repeat a spec_id add their ties to it."""
    ties = stored(nodes(specs.where("spec_id is not null")), "ties")
    pairs = ties.select(F.col("k")[0].alias("u"), F.explode("k").alias("v"))
    edges = pairs.groupBy("u", "v").agg(F.count("*").alias("n"))
    # the same spec_id under different keys ties them too
    again = ties.groupBy("spec_id").agg(F.min(F.col("k")[0]).alias("u"), F.max(F.col("k")[0]).alias("v")).where("u <> v").select("u", "v", F.lit(1).cast("long").alias("n"))
    tree, root = forest(edges.union(again))
    return ties, stored(tree, "forest"), root


def links(specs: DataFrame) -> DataFrame:
    """(u, v): the spanning forest of subjects (s:), authors (a:) and records that name neither (r:); what it joins lands in one split."""
    return tied(specs)[1]


def groups(specs: DataFrame) -> DataFrame:
    """(spec_id, group_key, root): one row per distinct spec_id.

    group_key is the smallest subject name of the group, or `record<spec_id>` where no record of the group names a subject.
    NULL spec_id is dropped; NULL, empty or meaningless subjects, doc_ids and authors tie nothing.
    """
    ties, _, root = tied(specs)
    named = root.where(F.col("node").startswith("s:")).groupBy("root").agg(F.min(F.substring("node", 3, 1 << 20)).alias("name"))
    keyed = root.join(small(named, 160), "root", "left").select(F.col("node").alias("k0"), "root", F.coalesce("name", F.regexp_replace(F.regexp_replace("root", "^r:", "record"), r"[^\p{L}\p{N}]+", "")).alias("group_key"))
    first = ties.groupBy("spec_id").agg(F.min(F.col("k")[0]).alias("k0"))
    return first.join(small(keyed, 240), "k0").select("spec_id", "group_key", "root")


def found(specs: DataFrame) -> DataFrame:
    return groups(specs).select("spec_id", "group_key")


def dealing(open_: dict[str, float], cards: int = ROUND) -> list[str]:
    """Splits of a round of groups: at each place the split that is furthest behind its share of the open records; ties by name."""
    want = {k: max(v, 0.0) for k, v in open_.items()}
    total = sum(want.values()) or 1.0
    share, given, out = {k: v / total for k, v in want.items()}, dict.fromkeys(want, 0), []
    for i in range(cards):
        best = max(sorted(share), key=lambda k: share[k] * (i + 1) - given[k])
        given[best] += 1
        out.append(best)
    return out


def assign(specs: DataFrame, targets: DataFrame) -> DataFrame:
    """(spec_id, group_key, new_split): every group in one split, shares near the targets.

    Groups are stratified by size band (powers of two). From the largest band down, the groups of a band, in hash order, are dealt
    systematically: the place in the round decides the split, by the shares that are still open, and what was dealt is taken off them, so that
    small groups even out what large ones left. The driver sees one sum a band and split. Without targets new_split is NULL.
    """
    member = stored(groups(specs), "groups")
    size = member.groupBy("group_key").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.log2("n")).cast("int"))
    order = ranked(size, ["band"], F.xxhash64("group_key"), F.lit(1).cast("long"))
    order = stored(order.select("group_key", "n", "band", F.pmod("before", F.lit(ROUND)).cast("int").alias("place")), "dealt")
    want = {r.split: float(r.target_share) for r in targets.where("split is not null and target_share > 0").groupBy("split").agg(F.max("target_share").alias("target_share")).orderBy("split").collect()}
    held = {(r.band, r.place): r.n for r in order.groupBy("band", "place").agg(F.sum("n").alias("n")).collect()}  # at most ROUND a band
    scale, total = sum(want.values()) or 1.0, sum(held.values())
    open_ = {k: v / scale * total for k, v in want.items()}
    deal = []
    for band in sorted({b for b, _ in held}, reverse=True):
        for place, split in enumerate(dealing(open_) if open_ else []):
            if (band, place) in held:
                open_[split] -= held[band, place]
                deal.append((band, place, split))
    table = F.broadcast(specs.sparkSession.createDataFrame(deal, "band int, place int, new_split string"))
    return member.join(small(order.join(table, ["band", "place"], "left").select("group_key", "new_split"), 120), "group_key").select("spec_id", "group_key", "new_split")


def report(specs: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, records, share, target_share) of the assignment."""
    a = assign(specs, targets).groupBy(F.col("new_split").alias("split")).agg(F.count("*").alias("records"))
    w = Window.partitionBy(F.lit(0))
    return a.withColumn("share", F.round(F.col("records") / F.sum("records").over(w), 6)).join(F.broadcast(targets.select("split", "target_share").distinct()), "split", "left")
