"""Greedy and goal-driven selection, deficit filling, strata, samples.

Order-dependent greedy rules are run as rounds over all rows: a candidate is settled as soon as nothing that comes
before it can still take what it claims. The outcome equals that of the one-by-one rule in the same order; the number
of rounds is logarithmic for hash orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.hashing import digest, shuffle_key
from ..session import Workspace
from .corpus import fragment_keys
from .integrity import require_empty

#: Characters of a source that one cell of span claims holds.
SPAN = 64


def greedy_disjoint(claims: DataFrame, work: Workspace) -> DataFrame:
    """(id): what a pass over the candidates in rank order would take, if it takes each whose claims are all still free.

    claims has one row (id, rank, claim) per claim; ranks are unique per id and comparable. In each round a candidate
    whose rank is the least of every claim it makes is taken, and all candidates that share a claim with it are out.
    Claims of one candidate alone never decide anything, so only contested ones go through the rounds.
    """
    every = claims.select("id", "rank", "claim").distinct()
    contested = every.groupBy("claim").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("claim")
    live = work.write(every.join(contested, "claim", "left_semi"), "live")
    taken = work.write(every.select("id").distinct().join(live.select("id").distinct(), "id", "left_anti"), "free")
    turn = 0
    while not live.isEmpty():
        least = live.groupBy("claim").agg(F.min(F.struct("rank", "id")).alias("first"))
        wins = live.join(least, "claim").groupBy("id").agg(F.min((F.col("first.id") == F.col("id")).cast("int")).alias("all_")).where("all_ = 1").select("id")
        won = work.write(wins, f"won{turn}")
        taken = taken.unionByName(won)
        spent = live.join(won, "id", "left_semi").select("claim").distinct()
        out = live.join(spent, "claim", "left_semi").select("id").distinct()
        live = work.write(live.join(out, "id", "left_anti"), "live")
        turn += 1
    return taken


def disjoint_excerpts(pool: DataFrame, seed: str, count: int | None = None, strict: bool = False) -> DataFrame:
    """Rows of pool (id, article_id, text) in hash order, no two with a common fragment of 16 characters or article;
    the first `count` of them if a count is given. Fewer than that are a ValueError if `strict`."""
    order = shuffle_key(F.col("id"), seed)
    grams = fragment_keys(pool, "id").select("id", F.col("h1").alias("claim"))
    owners = pool.where("article_id is not null").select("id", F.xxhash64(F.lit("article"), "article_id").alias("claim"))
    claims = grams.unionByName(owners).withColumn("rank", order)
    found = pool.join(greedy_disjoint(claims, Workspace(pool.sparkSession)), "id", "left_semi")
    if count is None:
        return found
    chosen = found.orderBy(order).limit(count)
    if strict and (n := chosen.count()) < count:
        raise ValueError(f"only {n} of {count} disjoint rows")
    return chosen


def rare_first_selection(candidates: DataFrame, goal: int) -> DataFrame:
    """(id, text, anchor): excerpts that bring every character of the pool to the goal as far as the pool allows.

    Characters come in ascending frequency. In each round every character that still lacks rows nominates as many
    candidates as it lacks, those with most lacking characters first, then longer, then by digest and id; nominees are taken
    greedily so that no two taken rows share a fragment or overlap in their article. Rounds end when no character
    lacks rows or nothing can be nominated.

    candidates: (id, article_id, start, end, text). One-by-one selection differs in its order only; goals, shortages,
    disjointness and the result for a given input are as fixed there. Fragments and spans of nominees are claims of the
    same greedy pass, spans by cells of SPAN characters, so two nominees whose spans touch one cell wait for each other.
    """
    work = Workspace(candidates.sparkSession)
    pool = work.write(candidates.where("text is not null"), "pool")
    chars = work.write(pool.select("id", F.explode(F.array_distinct(tx.characters(F.col("text")))).alias("character")), "characters")
    grams = work.write(fragment_keys(pool, "id").select("id", F.col("h1").alias("claim")).distinct(), "grams")
    cells = F.sequence(F.floor(F.col("start") / SPAN), F.floor((F.greatest("end", F.col("start") + 1) - 1) / SPAN))
    spans = pool.where("article_id is not null").select("id", F.explode(cells).alias("cell"), "article_id").select("id", F.xxhash64(F.lit("span"), "article_id", "cell").alias("claim"))
    # One row per character, at most the size of Unicode: small enough to be broadcast.
    lack = work.write(chars.groupBy("character").agg(F.count(F.lit(1)).alias("frequency")).withColumn("lacking", F.lit(goal).cast("long")), "lack")
    free = work.write(pool.select("id", "article_id", "start", "end", F.length("text").alias("size"), digest(F.col("text")).alias("digest")), "free")
    anchors = None
    turn = 0
    while True:
        wanted = chars.join(F.broadcast(lack), "character").join(free.select("id", "size", "digest"), "id")
        score = wanted.groupBy("id").agg(F.count(F.lit(1)).alias("score"))
        order = [F.desc("score"), F.desc("size"), F.col("digest"), F.col("id")]
        offers = wanted.join(score, "id").withColumn("k", F.row_number().over(Window.partitionBy("character").orderBy(*order))).where((F.col("k") <= goal) & (F.col("k") <= F.col("lacking")))
        best = work.write(offers.groupBy("id").agg(F.min(F.struct("frequency", "character", "k")).alias("rank")), "offers")
        if best.isEmpty():
            break
        claims = grams.unionByName(spans).join(best, "id").select("id", "rank", "claim")
        won = work.write(greedy_disjoint(claims, Workspace(candidates.sparkSession)).join(best.select("id", F.col("rank.character").alias("anchor")), "id"), f"taken{turn}")
        anchors = won if anchors is None else anchors.unionByName(won)
        gained = chars.join(won, "id", "left_semi").groupBy("character").agg(F.count(F.lit(1)).alias("n"))
        lack = work.write(lack.join(gained, "character", "left").select("character", "frequency", (F.col("lacking") - F.coalesce("n", F.lit(0))).alias("lacking")).where("lacking > 0"), "lack")
        spent = grams.join(won, "id", "left_semi").select("claim").distinct()
        out = won.select("id").unionByName(grams.join(spent, "claim", "left_semi").select("id")).unionByName(overlapping(free, pool.join(won, "id", "left_semi"))).distinct()
        free = work.write(free.join(out, "id", "left_anti"), "free")
        turn += 1
    if anchors is None:
        return pool.select("id", "text", F.lit(None).cast("string").alias("anchor")).limit(0)
    return pool.join(anchors, "id").select("id", "text", "anchor")


def overlapping(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """(id): rows (id, article_id, start, end) that overlap a taken one in their article. Both sides meet in cells of SPAN
    characters, so an article that holds a third of all rows is spread over the cells of its length."""
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / SPAN), F.floor((F.greatest(b, F.col(a) + 1) - 1) / SPAN)))
    own = rows.select("id", "article_id", "start", "end").withColumn("cell", cell("start", "end"))
    other = taken.select("article_id", F.col("start").alias("s"), F.col("end").alias("e")).withColumn("cell", cell("s", "e"))
    return own.join(other, ["article_id", "cell"]).where((F.col("start") < F.col("e")) & (F.col("s") < F.col("end"))).select("id").distinct()


def first_per_pattern(hits: DataFrame, goal: int) -> DataFrame:
    """(pattern, id, article_id, k): of rows (pattern, id, article_id, rank) the first of each article and pattern, and of
    those the first `goal` of each pattern. A row chosen for one pattern counts for every pattern it holds."""
    one = hits.withColumn("a", F.row_number().over(Window.partitionBy("pattern", "article_id").orderBy("rank", "id"))).where("a = 1")
    return one.withColumn("k", F.row_number().over(Window.partitionBy("pattern").orderBy("rank", "id"))).where(F.col("k") <= goal).select("pattern", "id", "article_id", "k")


def balanced_pick(pool: DataFrame, characters: str, goal: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(chosen, shortages): up to `goal` rows per character, one per language and article, in hash order, no shared
    fragments; (character, chosen, shortage) for every character. Shortages are reported, never filled.

    In each round every character that is still short nominates as many rows as it lacks, the first in hash order that are
    free of taken fragments and articles; the nominees that a pass in hash order would take are taken, and only those block
    others. A row taken for one character counts for every character it holds that is still short, up to the goal. Rounds
    end when no character is short or nothing can be nominated, so a shortage means that no usable row is left.
    """
    work = Workspace(pool.sparkSession)
    held = F.array_distinct(F.filter(tx.characters(F.col("text")), lambda c: F.lit(characters).contains(c)))
    rows = work.write(pool.withColumn("held_", held).where(F.size("held_") > 0).withColumn("rank_", shuffle_key(F.col("id"), seed)), "rows")
    claims = work.write(fragment_keys(rows, "id").select("id", F.col("h1").alias("claim")).unionByName(rows.select("id", F.xxhash64(F.lit("article"), "language", "article_id").alias("claim"))), "claims")
    free = work.write(rows.select("id", "rank_", F.explode("held_").alias("character")), "free")
    lack = {c: goal for c in dict.fromkeys(characters)}
    parts, turn = [], 0
    while any(lack.values()):
        short = F.create_map(*[F.lit(x) for c, n in lack.items() for x in (c, n)])
        near = free.withColumn("short", F.element_at(short, F.col("character"))).where("short > 0").withColumn("k", F.row_number().over(Window.partitionBy("character").orderBy("rank_", "id"))).where((F.col("k") <= goal) & (F.col("k") <= F.col("short")))
        offers = work.write(near.select("id", F.col("rank_").alias("rank")).distinct(), "offers")
        if offers.isEmpty():
            break
        won = work.write(greedy_disjoint(claims.join(F.broadcast(offers), "id"), Workspace(pool.sparkSession)), f"won{turn}")
        mine = free.join(F.broadcast(won), "id", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("character").orderBy("rank_", "id"))).where(F.col("k") <= F.element_at(short, F.col("character")))
        mine = work.write(mine.select("id", "character"), f"chosen{turn}")
        for r in mine.groupBy("character").count().collect():
            lack[r["character"]] -= r["count"]
        parts.append(mine)
        spent = claims.join(F.broadcast(won), "id", "left_semi").select("claim").distinct()
        blocked = claims.join(F.broadcast(spent), "claim", "left_semi").select("id").distinct()
        free = work.write(free.join(blocked, "id", "left_anti"), "free")
        turn += 1
    chosen = rows.select("id", F.explode("held_").alias("character")).limit(0)
    for part in parts:
        chosen = chosen.unionByName(part)
    counts = chosen.groupBy("character").agg(F.count(F.lit(1)).alias("chosen"))
    all_ = pool.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(characters)], "character string")
    report = all_.join(counts, "character", "left").select("character", F.coalesce("chosen", F.lit(0)).alias("chosen"), (goal - F.coalesce("chosen", F.lit(0))).alias("shortage"))
    return rows.drop("held_", "rank_").join(chosen, "id"), report


def strict_pick(pool: DataFrame, characters: str, goal: int, seed: str) -> DataFrame:
    """What balanced_pick chooses; a character that is short is a ValueError."""
    chosen, report = balanced_pick(pool, characters, goal, seed)
    require_empty(report.where("shortage > 0"), "too few rows")
    return chosen


def deficit_lines(lacking: DataFrame, alphabet: str, per_line: int, length: int, seed: str) -> DataFrame:
    """(text, embedded_targets): lines that hold every lacking character (character, shortfall) as often as it lacks.

    Each shortfall becomes numbered places; copy n of a character goes to a line of layer n, so no line holds a
    character twice, and lines of a layer take at most per_line characters in hash order. The rest of a line is
    drawn from the alphabet by hash, without the line's targets.
    """
    places = lacking.where("shortfall > 0").select("character", F.explode(F.sequence(F.lit(1), F.col("shortfall").cast("int"))).alias("layer"))
    order = shuffle_key(F.concat_ws("/", "layer", "character"), seed)
    lined = places.withColumn("n", F.row_number().over(Window.partitionBy("layer").orderBy(order))).withColumn("line", F.ceil(F.col("n") / per_line)).groupBy("layer", "line").agg(F.array_sort(F.collect_list("character")).alias("targets"))
    key = F.concat_ws("/", F.lit(seed), "layer", "line")
    at = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.struct(F.xxhash64(key, i).alias("h"), i.alias("i")))), 1, F.size("targets"))
    letters = F.filter(F.array(*map(F.lit, dict.fromkeys(alphabet))), lambda c: ~F.array_contains("targets", c))
    rows = lined.withColumn("at", F.transform(at, lambda x: x["i"])).withColumn("letters", letters)
    char = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.get(F.col("targets"), F.nullif(F.array_position("at", i), F.lit(0)).cast("int") - 1), F.get(F.col("letters"), F.pmod(F.xxhash64(key, F.lit("fill"), i), F.size("letters")).cast("int"))))
    embedded = F.transform(F.arrays_zip("targets", "at"), lambda x: F.struct(x["targets"].alias("character"), x["at"].alias("position")))
    return rows.select(F.array_join(char, "").alias("text"), embedded.alias("embedded_targets"))


def deficit_substitutions(lacking: DataFrame, donors: DataFrame, classes: DataFrame, seed: str) -> DataFrame:
    """(donor_id, base_text, position, from, to, text): one changed donor per missing copy of a character.

    lacking (character, shortfall); donors (id, text); classes (character, class), a bounded alphabet. A place goes to an
    unused donor that holds a character of its class other than the wanted one; the first such character is replaced. A
    donor serves once. Classes with few donors choose first, donors with several characters of the class go before those
    with one, then in hash order. A class is left only when no unused donor fits any of its open places, so a place
    without donor (compare with the shortfall) has none left.
    """
    work = Workspace(donors.sparkSession)
    alphabet = [(r["character"], r["class"]) for r in classes.where("character is not null and class is not null").select("character", "class").distinct().collect()]
    places = lacking.where("shortfall > 0").join(classes, "character").select("character", "class", F.explode(F.sequence(F.lit(1), F.col("shortfall").cast("int"))).alias("copy"))
    places = work.write(places.withColumn("h", shuffle_key(F.concat_ws("/", "copy", "character"), seed)), "places")
    # Each character of the alphabet is read as a private-use letter of its class.
    letters = {c: chr(0xE000 + k) for k, c in enumerate(sorted({c for _, c in alphabet}))}
    source, target = "".join(c for c, _ in alphabet), "".join(letters[c] for _, c in alphabet)
    foreign = "".join(letters.values())

    def read(text: Column) -> Column:
        # A letter that a text itself holds is read as its own class, or as none.
        return F.translate(text, source + foreign, target + "\uffff" * len(foreign))

    lines = work.write(donors.where("id is not null and text is not null").select("id", "text", read(F.col("text")).alias("read")), "lines")
    wanted = [r["class"] for r in places.select("class").distinct().collect()]
    found = lines.agg(F.count(F.lit(1)), *[F.count_if(F.contains("read", F.lit(letters[c]))).alias(f"n{k}") for k, c in enumerate(wanted)]).first()
    out = []
    for k, own in sorted(enumerate(wanted), key=lambda x: (found[f"n{x[0]}"], x[1])):
        letter = F.lit(letters[own])
        open_ = places.where(F.col("class") == own)
        first = lines.where(F.contains("read", letter)).withColumn("p", F.instr("read", letter)).withColumn("c", F.substr("text", F.col("p"), F.lit(1)))
        # The first character of the class that differs from the first one.
        second = first.withColumn("q", F.instr(read(F.replace("text", F.col("c"), F.lit("\uffff"))), letter))
        turn = dry = 0
        while dry < 2 and (left := open_.count()):
            free = second
            for done in out:
                free = free.join(F.broadcast(done.select(F.col("donor_id").alias("id"))), "id", "left_anti")
            # Whether both orders run dry decides: then one character is all that is wanted and all that donors have.
            only = F.when(F.col("q") == 0, F.col("c"))
            direction, against = (F.asc_nulls_first, F.desc) if turn % 2 == 0 else (F.desc_nulls_first, F.asc)
            order = [direction("only"), shuffle_key(F.col("id"), seed), F.col("id")]
            drawn = free.withColumn("only", only).orderBy(*order).limit(left).withColumn("n", F.row_number().over(Window.orderBy(*order)))
            asked = open_.withColumn("n", F.row_number().over(Window.orderBy(against("character"), "h")))
            fits = asked.join(drawn, "n").where((F.col("character") != F.col("c")) | (F.col("q") > 0))
            at = F.when(F.col("character") != F.col("c"), F.col("p")).otherwise(F.col("q"))
            changed = F.concat(F.substr("text", F.lit(1), at - 1), F.col("character"), F.substr("text", at + 1))
            made = fits.select(F.col("id").alias("donor_id"), F.col("text").alias("base_text"), (at - 1).alias("position"), F.substr("text", at, F.lit(1)).alias("from"), F.col("character").alias("to"), changed.alias("text"), "copy")
            made = work.write(made, f"made{k}-{turn}")
            turn += 1
            if made.isEmpty():
                dry += 1
                continue
            dry = 0
            out.append(made)
            open_ = open_.join(F.broadcast(made.select(F.col("to").alias("character"), "copy")), ["character", "copy"], "left_anti")
    names = ["donor_id", "base_text", "position", "from", "to", "text"]
    if not out:
        return donors.select(F.col("id").alias("donor_id"), F.col("text").alias("base_text"), F.lit(0).alias("position"), F.lit("").alias("from"), F.lit("").alias("to"), "text").limit(0)
    result = out[0]
    for made in out[1:]:
        result = result.unionByName(made)
    return result.select(*names)


def round_robin(df: DataFrame, strata: list[str], order: Column, n: int) -> DataFrame:
    """n rows by turns from the strata: first of each, then the second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(order))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", *strata).limit(n)


def balanced_values(df: DataFrame, partition: list[Column], order: Column, values: list) -> Column:
    """values[i mod n] for the i-th row of its partition."""
    i = F.row_number().over(Window.partitionBy(*partition).orderBy(order)) - 1
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def third_pages(pages: DataFrame, document: str, page: str, size: Column) -> DataFrame:
    """Pages ceil(N/3) and ceil(2N/3) of each document's N pages of positive size."""
    w = Window.partitionBy(document)
    rows = pages.where(size > 0).withColumn("i", F.row_number().over(w.orderBy(page))).withColumn("n", F.count(F.lit(1)).over(w))
    return rows.where((F.col("i") == F.floor((F.col("n") + 2) / 3)) | (F.col("i") == F.floor((2 * F.col("n") + 2) / 3))).drop("i", "n")


def within_budget(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each key in order until the sizes before them reach the budget (the row that reaches it is kept)."""
    before = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget)


def before_overflow(df: DataFrame, key: str, order: str, fits: str, heading: str, fraction: float) -> DataFrame:
    """Rows of each key before the first that does not fit, that fraction of them (at least one), without the headings
    that would then stand last."""
    w = Window.partitionBy(key)
    rows = df.withColumn("i", F.row_number().over(w.orderBy(order))).withColumn("first", F.min(F.when(~F.col(fits), F.col("i"))).over(w))
    rows = rows.withColumn("capacity", F.coalesce(F.col("first") - 1, F.count(F.lit(1)).over(w)))
    rows = rows.where("capacity > 0").withColumn("keep", F.greatest(F.lit(1), F.floor(F.col("capacity") * fraction))).where("i <= keep")
    last = F.max(F.when(~F.col(heading), F.col("i"))).over(w)
    return rows.withColumn("last", last).where("i <= last").drop("first", "capacity", "keep", "last", "i")


def paragraph_excerpt(text: Column, budget: int) -> Column:
    """Paragraphs of at least 40 characters until the budget is used; one that is too long is cut after its last 。 from
    the 61st character on, else at the budget; nothing more once under 80 characters are left."""
    paragraphs = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), tx.trim_edges), lambda p: F.length(p) >= 40)

    def add(acc, p):
        head = F.substr(p, F.lit(1), acc["left"])
        stop = F.length(head) - F.coalesce(F.nullif(F.locate("。", F.reverse(head)), F.lit(0)), F.length(head) + 1) + 1
        cut = F.when(F.length(p) <= acc["left"], p).when(stop >= 61, F.substr(head, F.lit(1), stop)).otherwise(head)
        left = acc["left"] - F.length(cut)
        grown = F.struct(left.alias("left"), (left < 80).alias("full"), F.concat(acc["out"], F.array(cut)).alias("out"))
        return F.when(acc["full"] | (F.length(cut) == 0), acc).otherwise(grown)

    start = F.struct(F.lit(budget).alias("left"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(paragraphs, start, add, lambda acc: acc["out"])


def hash_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows of least hash: a uniform sample of fixed size, and a shuffle of it, that any engine repeats."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def weighted_choice(key: Column, seed: str, weights: dict[str, float]) -> Column:
    """One of the names with probability in proportion to its weight, by the first 52 bits of the key's digest."""
    total = sum(weights.values())
    u = (F.conv(F.substring(shuffle_key(key, seed), 1, 13), 16, 10).cast("double") / float(1 << 52)) * total
    out, upto = F.lit(list(weights)[-1]), total
    for name, w in reversed(list(weights.items())):
        upto -= w
        out = F.when(u < upto + w, F.lit(name)).otherwise(out)
    return out


def wrapping_budget(records: DataFrame, starts: DataFrame, ring: str, order: str, size: str, budget: int) -> DataFrame:
    """(ring, start, order, turn, enough): records of a ring from each start on, going round at its end, until their sizes
    reach the budget (the record that reaches it is kept); each record at most once. `enough` tells whether it was reached.

    starts (ring, start) name records by their order. Sizes are summed once per ring; a start is a shift of these sums.
    """
    w = Window.partitionBy(ring).orderBy(order)
    summed = records.select(ring, order, size).withColumn("i", F.row_number().over(w)).withColumn("upto", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("whole", F.sum(size).over(Window.partitionBy(ring))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(ring)))
    first = summed.join(starts.select(ring, F.col("start").alias(order)), [ring, order]).select(ring, F.col(order).alias("start"), F.col("i").alias("i0"), (F.col("upto") - F.col(size)).alias("base"))
    rows = summed.join(first, ring)
    turned = F.col("i") < F.col("i0")
    before = F.col("upto") - F.col(size) - F.col("base") + F.when(turned, F.col("whole")).otherwise(F.lit(0))
    turn = F.col("i") - F.col("i0") + F.when(turned, F.col("n")).otherwise(F.lit(0))
    return rows.withColumn("turn", turn).where(before < budget).select(ring, "start", order, "turn", (F.col("whole") >= budget).alias("enough"))
