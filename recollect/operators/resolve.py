"""Entity resolution of facts: exact classes, near-duplicate links, and the greedy keep-first merge."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def with_signature(facts: DataFrame, text: str) -> DataFrame:
    # the tokens are a column of their own first, so that what follows from them does not compute them again
    return facts.withColumn("tokens", X.tokens(F.col(text))).withColumns({k: c for k, c in X.signature(F.col(text), F.col("tokens")).items() if k != "tokens"})


def exact_dedup(facts: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """Keep-first by dedup key, in order of key: one row for each class with its size.

    strict drops facts whose key is empty; else their lower-cased text is the key.
    """
    keyed = facts.withColumn("_key", X.dedup_key(F.col(text)) if strict else X.kept_dedup_key(F.col(text)))
    kept = keyed.where("_key <> ''") if strict else keyed
    return kept.groupBy("_key").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n_merged")).select(key, F.col("_key").alias("dedup_key"), "n_merged")


def _digest(*parts: Column) -> Column:
    """SHA-256 of parts that hold no bar: what long signatures are grouped and joined by.

    Never null, so that no join filters by it first, which would compute it twice and keep equal stages from being shared.
    """
    return F.coalesce(F.sha2(F.concat_ws("|", *parts), 256), F.lit(""))


def _signature_digest() -> Column:
    return _digest(F.array_join("tokens", " "), F.col("subject"), F.col("proper_key"))


def signature_classes(facts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes): facts with equal signatures are one class, which its least key represents.

    Signatures are as long as their texts, so only digests of them (_sig, _proper) are moved.
    """
    signed = with_signature(facts.select(key, text), text).select(key, _signature_digest().alias("_sig"), _digest(F.col("proper_key")).alias("_proper"))
    classes = signed.groupBy("_sig", "_proper").agg(F.min(key).alias("class_id"))
    return signed.join(classes, ["_sig", "_proper"]).select(key, "class_id"), classes


#: Classes of equal proper nouns up to which all of them meet, and classes of a block: a task compares two blocks.
MEET_ALL, PER_BLOCK = 2048, 256
#: Columns of the matrices of a task.
COLUMNS = 4096


def _least_shared() -> Column:
    """Tokens that a set shares at least with any that says the same; reworded ones share core tokens."""
    n, core = F.size("tokens"), F.size("core")
    alike = F.ceil(n * X.SAME_JACCARD - 1e-9)
    reworded = F.greatest(F.ceil(core * X.SAME_CORE_SHARE - 1e-9), F.lit(X.SAME_CORE).cast("long"))
    return F.greatest(F.when(F.col("sentiment"), F.least(alike, reworded)).otherwise(alike), F.lit(1).cast("long"))


def _prefixes(sets: DataFrame, by: list[str], of: str, counted: DataFrame | None = None) -> DataFrame:
    """sets with tokens in order of rarity, a row for each token t that can be the first one shared with a set that says
    the same, and before: the tokens before t. `by` names a set; frequencies are those among equal `of`, in counted."""
    each = sets.select(*by, of, F.explode("tokens").alias("t"))
    counted = each if counted is None else counted.select(of, F.explode("tokens").alias("t"))
    ranked = each.join(counted.groupBy(of, "t").agg(F.count(F.lit(1)).alias("_df")), [of, "t"])
    ordered = ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_df", "t"))), lambda s: s["t"]).alias("_ordered"))
    rows = sets.join(ordered, by).withColumn("tokens", F.col("_ordered")).drop("_ordered")
    prefix = F.slice("tokens", F.lit(1), (F.size("tokens") - _least_shared() + 1).cast("int"))
    return rows.select(*rows.columns, F.posexplode(prefix).alias("before", "t"))


def _meeting(facts: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of blocks of classes that can say the same, a row (_proper, t, i, j, own, ...) for each class of a pair.

    Proper nouns must be equal, so the signatures of classes alone with theirs are never moved. Up to MEET_ALL classes
    of equal proper nouns all meet; of more, those that have a token t in their prefixes. Both are cut into blocks.
    """
    groups = classes.groupBy("_proper").agg(F.min("class_id").alias("_low"), F.max("class_id").alias("_high"), F.count("class_id").alias("m")).where("_low < _high")
    wanted = classes.join(groups.select("_proper", "m"), "_proper")
    own = facts.select(F.col(key).alias("class_id"), F.col(text).alias("_text")).join(wanted, "class_id")
    # an id may have several texts; as an equality this would become a key of the join, computed for all texts
    signed = with_signature(own, "_text").where(F.array_contains(F.array("_sig"), _signature_digest()) & (F.size("tokens") > 0))
    signed = signed.select("class_id", "_sig", "_proper", "m", "tokens", "subject", "sentiment", "core").dropDuplicates(["class_id", "_sig"])
    all_meet = F.col("m") <= MEET_ALL
    few = signed.where(all_meet).select("*", F.lit(0).alias("before"), F.lit("").alias("t"))
    many = _prefixes(signed.where(~all_meet).drop("m"), ["class_id", "_sig"], "_proper")
    sizes = many.groupBy("_proper", "t").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = few.unionByName(many.join(sizes, ["_proper", "t"])).drop("core")
    blocks = F.ceil(F.col("m") / PER_BLOCK).cast("int")
    placed = rows.withColumn("own", F.pmod(F.xxhash64("_sig"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return placed.select("_proper", "t", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"), "own", "class_id", "tokens", "subject", "sentiment", "before")


def _shared(left: tuple, right: tuple, shape: tuple[int, int], width: int) -> np.ndarray:
    """How many tokens each set of the left shares with each of the right; a side is (row, token) pairs, as two arrays."""
    out = np.zeros(shape, np.float32)
    for at in range(0, width, COLUMNS):
        sides = []
        for (row, token), n in ((left, shape[0]), (right, shape[1])):
            inside = (token >= at) & (token < at + COLUMNS)
            sides.append(np.zeros((n, min(COLUMNS, width - at)), np.float32))
            sides[-1][row[inside], token[inside] - at] = 1
        out += sides[0] @ sides[1].T
    return out


def _same_in_blocks(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of block i, ids of block j, which say the same): X.same_fact() on two blocks of equal proper nouns.

    A pair that meets for several tokens counts where no token before is shared.
    """
    verbs = set(X.SENTIMENT_VERBS)
    i, j = group["i"].iloc[0], group["j"].iloc[0]
    sides = [group[group["own"] == k] for k in (i, j)]
    number: dict[str, int] = {}
    flat = []
    for side in sides:
        lists = list(side["tokens"])
        sizes = np.array([len(x) for x in lists], np.int64)
        row = np.repeat(np.arange(len(lists)), sizes)
        token = np.array([number.setdefault(t, len(number)) for x in lists for t in x], np.int64)
        within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat.append((row, token, within < np.repeat(side["before"].to_numpy(), sizes), sizes))
    # tokens of one side only are shared by nobody
    both = np.flatnonzero(np.isin(np.arange(len(number)), flat[0][1]) & np.isin(np.arange(len(number)), flat[1][1]))
    place = np.full(len(number), -1)
    place[both] = np.arange(len(both))
    is_verb = np.array([t in verbs for t in number], bool)
    shape = (len(sides[0]), len(sides[1]))

    def shared(kept) -> np.ndarray:
        chosen = [(row[k], place[token[k]]) for row, token, before, _ in flat for k in [kept(token, before) & (place[token] >= 0)]]
        return _shared(*chosen, shape, len(both))

    ids = [side["class_id"].to_numpy() for side in sides]
    subject = [side["subject"].to_numpy() for side in sides]
    common = shared(lambda token, before: np.ones(len(token), bool)).astype(np.int64)
    sizes = flat[0][3][:, None] + flat[1][3][None, :]
    same = common / np.maximum(sizes - common, 1) >= X.SAME_JACCARD
    told = np.outer(*(side["sentiment"].to_numpy(bool) for side in sides))
    if told.any():
        verb = [np.bincount(row[is_verb[token]], minlength=n) for (row, token, _, _), n in zip(flat, shape, strict=True)]
        core = common - shared(lambda token, before: is_verb[token]).astype(np.int64)
        union = sizes - verb[0][:, None] - verb[1][None, :] - core
        same |= told & (core >= X.SAME_CORE) & (core / np.maximum(union, 1) >= X.SAME_CORE_SHARE)
    same &= (subject[0][:, None] == "") | (subject[1][None, :] == "") | (subject[0][:, None] == subject[1][None, :])
    same &= ids[0][:, None] != ids[1][None, :]
    if any(before.any() for _, _, before, _ in flat):
        same &= shared(lambda token, before: before) == 0
    return ids[0], ids[1], same


def near_dup_links(facts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, links): links between class representatives that pass the same-fact predicate."""
    members, classes = signature_classes(facts, key, text)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _same_in_blocks(group)
        x, y = np.nonzero(same)
        pairs = pd.DataFrame({"a": left[x], "b": right[y]})
        return pairs[pairs["a"] < pairs["b"]] if group["i"].iloc[0] == group["j"].iloc[0] else pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    kind = facts.schema[key].dataType.simpleString()
    return members, _meeting(facts, classes, key, text).groupBy("_proper", "t", "i", "j").applyInPandas(run, f"a {kind}, b {kind}")


def near_dups(facts: DataFrame, key: str, text: str) -> DataFrame:
    """Each fact with its class and the number of other classes that say the same; links are counted, never listed."""
    members, classes = signature_classes(facts, key, text)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _same_in_blocks(group)
        ids, n = left, same.sum(axis=1)
        if group["i"].iloc[0] != group["j"].iloc[0]:
            ids, n = np.concatenate([left, right]), np.concatenate([n, same.sum(axis=0)])
        return pd.DataFrame({"class_id": ids[n > 0], "n": n[n > 0]})

    kind = facts.schema[key].dataType.simpleString()
    found = _meeting(facts, classes, key, text).groupBy("_proper", "t", "i", "j").applyInPandas(run, f"class_id {kind}, n long")
    counts = found.groupBy("class_id").agg(F.sum("n").alias("n_links"))
    return members.join(counts, "class_id", "left").select(key, "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def greedy_merge(facts: DataFrame, corpus: str, pos: str, text: str, sources: str) -> DataFrame:
    """Keep-first merge in order of pos within each corpus: an exact key, else the first fact that says the same.

    The kept fact takes over the sources of those it absorbs, first ones first. The relation is not transitive,
    so order decides, and a corpus (the facts of one conversation) is merged by one task. Within it facts meet only
    those of equal key, or of equal proper nouns with a token in common. Facts with an empty dedup key compare by their
    lower-cased text.
    """
    signed = with_signature(facts.select(corpus, pos, text, sources), text).withColumn("key", X.kept_dedup_key(F.col(text)))
    kinds = facts.schema
    out = f"{corpus} {kinds[corpus].dataType.simpleString()}, {pos} {kinds[pos].dataType.simpleString()}, {text} string, {sources} array<string>, n_merged long"

    def same(a, b) -> bool:
        x, y = a["token_set"], b["token_set"]
        if not x or not y or (a["subject"] and b["subject"] and a["subject"] != b["subject"]):
            return False
        if len(x & y) >= X.SAME_JACCARD * len(x | y):
            return True
        if not (a["sentiment"] and b["sentiment"] and a["core_set"] and b["core_set"]):
            return False
        shared = len(a["core_set"] & b["core_set"])
        return shared >= X.SAME_CORE and shared / len(a["core_set"] | b["core_set"]) >= X.SAME_CORE_SHARE

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        by_key: dict[str, dict] = {}
        by_token: dict[tuple[str, str], list[dict]] = {}
        for row in group.sort_values(pos, kind="stable").to_dict("records"):
            row["token_set"], row["core_set"] = frozenset(row["tokens"]), frozenset(row["core"])
            hit = by_key.get(row["key"])
            if hit is None:
                near = {c["n"]: c for t in row["token_set"] for c in by_token.get((row["proper_key"], t), ())}
                hit = next((near[n] for n in sorted(near) if same(row, near[n])), None)
            if hit is None:
                row |= {"n": len(kept), "sources": dict.fromkeys(row[sources]), "n_merged": 1}
                kept.append(row)
                by_key[row["key"]] = row
                for t in row["token_set"]:
                    by_token.setdefault((row["proper_key"], t), []).append(row)
            else:
                hit["sources"] |= dict.fromkeys(row[sources])
                hit["n_merged"] += 1
        return pd.DataFrame([{corpus: r[corpus], pos: r[pos], text: r[text], sources: list(r["sources"]), "n_merged": r["n_merged"]} for r in kept], columns=[corpus, pos, text, sources, "n_merged"])

    return signed.groupBy(corpus).applyInPandas(merge, out)


def not_yet_known(incoming: DataFrame, stored: DataFrame, key: str, text: str, sources: str) -> DataFrame:
    """Incoming facts without a stored one that says the same and has all their sources.

    Of facts with equal signatures and sources one is compared. They meet where their proper nouns are equal and both
    prefixes in order of rarity have a token; which pairs meet is never written, the first stored one found is enough.
    """
    listed = F.to_json(F.array_sort(F.array_distinct(sources)))
    told = lambda rows: with_signature(rows, text).withColumn("_of", F.coalesce(F.sha2(F.concat_ws("|", F.array_join("tokens", " "), "subject", "proper_key", listed), 256), F.lit("")))
    one = lambda rows: told(rows.select(text, sources)).drop(text).dropDuplicates(["_of"])
    new, old = one(incoming), one(stored)
    both = new.select("proper_key", "tokens").unionByName(old.select("proper_key", "tokens"))
    side = lambda sets, p: (rows := _prefixes(sets, ["_of"], "proper_key", both)).select(*(F.col(c).alias(p + c) for c in rows.columns))
    x, y = side(new, "x_"), side(old, "y_")
    n, m = F.size("x_tokens"), F.size("y_tokens")
    sizes = (F.least(n, m) >= F.greatest(n, m) * X.SAME_JACCARD - 1e-9) | (F.col("x_sentiment") & F.col("y_sentiment"))
    nothing_new = F.size(F.array_except(f"x_{sources}", f"y_{sources}")) == 0
    meet = (F.col("x_proper_key") == F.col("y_proper_key")) & (F.col("x_t") == F.col("y_t"))
    known = x.join(y, meet & sizes & nothing_new & X.same_fact("x_", "y_"), "left_semi").select(F.col("x__of").alias("_of")).distinct()
    return told(incoming).join(known, "_of", "left_anti").select(*incoming.columns)
