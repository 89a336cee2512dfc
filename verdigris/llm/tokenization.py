"""Byte-pair encoding with a public vocabulary, wholly in expressions of the JVM.

Each distinct word of the corpus is folded exactly once: a word is an array of one-byte binary pieces, and a higher-order fold merges in every step all
occurrences of the pair of lowest rank. The rank map is one literal: an array of small maps by hash, since a map is searched from its start. Where two
neighbouring bytes stand together in no piece of the vocabulary, nothing is ever merged across them, so words are cut there first and a long word costs
no more than its parts.

The ids of the words then go back to the texts: those of the most frequent words by a second literal of bounded size, those of all others by a join of
their occurrences only.
"""

from __future__ import annotations

import base64
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.session import cut_lineage, shuffle_partitions

#: Folder of the vocabulary files.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the code points of Unicode white space, as a part of a character class.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the pattern that cuts texts into words before any merge.
WORD_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?(?:\p{{L}}++|\p{{N}}++|[^{_SPACE}\p{{L}}\p{{N}}]++)|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Words whose ids go to the texts by the literal, and the longest of them in bytes; together they bound its size. All words are folded alike.
LITERAL_WORDS = 131_072
LITERAL_WORD_BYTES = 256
_BUCKETS = 65_536
#: Stands for pairs that are no piece; in the rank map also the mark of byte pairs that occur within longer pieces only.
_NO_RANK = (1 << 31) - 1
_INTS = "array<int>"


def read_ranks(folder: str = VOCABULARIES, name: str = VOCABULARY) -> dict[bytes, int]:
    """The rank of each piece of a rank file."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


class Literals:
    """Values of any size as literals of expressions, by session variables, which are dropped at the end.

    Expressions with lambdas take no subquery. A query takes in the value of a variable when it is built, so it outlives the variable.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._names = spark, []

    def __enter__(self) -> Literals:
        return self

    def __exit__(self, *_) -> None:
        for name in self._names:
            self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")

    def value(self, row: DataFrame) -> Column:
        """The only value of `row`."""
        name = f"verdigris_{uuid.uuid4().hex}"
        row.createOrReplaceTempView(name)
        self.spark.sql(f"DECLARE VARIABLE {name} {row.schema['value'].dataType.simpleString()}")
        self._names.append(name)
        self.spark.sql(f"SET VARIABLE {name} = (SELECT value FROM {name})")
        self.spark.catalog.dropTempView(name)
        return F.expr(f"system.session.{name}")

    def table(self, entries: DataFrame) -> Column:
        """(key, value) rows as one array of maps, the map of a key at the place of its hash."""
        kind = dict(entries.dtypes)
        maps = entries.groupBy(_bucket(F.col("key")).alias("bucket")).agg(F.collect_list(F.struct("key", "value")).alias("part"))
        places = self.spark.range(_BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(maps, "bucket", "left")
        ordered = places.agg(F.array_sort(F.collect_list(F.struct("bucket", "part"))).alias("all"))
        empty = F.array().cast(f"array<struct<key:{kind['key']},value:{kind['value']}>>")
        return self.value(ordered.select(F.transform("all", lambda b: F.map_from_entries(F.coalesce(b["part"], empty))).alias("value")))


def _bucket(key: Column) -> Column:
    return F.pmod(F.hash(key), F.lit(_BUCKETS))


def _lookup(literal: Column, key: Column) -> Column:
    return F.element_at(F.element_at(literal, _bucket(key) + 1), key)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_map(literals: Literals, ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal, with the byte pairs that stand together within some piece only."""
    inner = {piece[i : i + 2]: _NO_RANK for piece in ranks for i in range(len(piece) - 1)}
    rows = [(bytearray(k), v) for k, v in (inner | ranks).items()]
    return literals.table(literals.spark.createDataFrame(rows, "key binary, value int"))


def encode_word(word: Column, ranks: Column) -> Column:
    """The ids of one word: an array of int."""

    def rank(piece: Column) -> Column:
        return F.coalesce(_lookup(ranks, piece), F.lit(_NO_RANK))

    def pair_ranks(pieces: Column) -> Column:
        return F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: rank(F.concat(F.get(pieces, i - 1), F.get(pieces, i))))).otherwise(F.array().cast(_INTS))

    def state(pieces: Column, pairs: Column, at: Column) -> Column:
        return F.struct(pieces.alias("pieces"), pairs.alias("pairs"), at.alias("at"))

    none = F.array().cast(_INTS)

    def merge_one(pieces: Column, pairs: Column, at: Column) -> Column:
        """The pieces at `at` and after it become one."""
        both = F.concat(F.get(pieces, at - 1), F.get(pieces, at))
        left = F.when(at > 1, F.array(rank(F.concat(F.get(pieces, at - 2), both)))).otherwise(none)
        right = F.when(at + 1 < F.size(pieces), F.array(rank(F.concat(both, F.get(pieces, at + 1))))).otherwise(none)
        return state(
            F.concat(F.slice(pieces, 1, at - 1), F.array(both), F.slice(pieces, at + 2, F.size(pieces))),
            F.concat(F.slice(pairs, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(pairs, at + 2, F.size(pieces))),
            F.lit(0),
        )

    def merge_all(pieces: Column, pairs: Column, low: Column, at: Column) -> Column:
        """All pairs of rank `low` at once, from the left; only the first where a merge would give rise to a pair of lower rank, which then comes first."""
        # For each piece: x is merged with the next, - goes into the one before, 0 stays.
        marks = F.concat(F.array_join(F.transform(pairs, lambda p: F.when(p == low, F.lit("1")).otherwise(F.lit("0"))), ""), F.lit("0"))

        def marked(mark: Column) -> Column:
            # What a merged piece would form with the next piece before that one is merged itself.
            between = F.exists(
                F.sequence(F.lit(0), F.size(pieces) - 3),
                lambda i: (F.get(mark, i) == "x") & (F.get(mark, i + 2) == "x") & (rank(F.concat(F.get(pieces, i), F.get(pieces, i + 1), F.get(pieces, i + 2))) < low),
            )
            joined = F.transform(pieces, lambda p, i: F.when(F.get(mark, i) == "x", F.concat(p, F.get(pieces, i + 1))).when(F.get(mark, i) == "0", p))
            together = _let(F.array_compact(joined), lambda new: state(new, pair_ranks(new), F.lit(0)))
            return _let(together, lambda new: F.when(between | (F.coalesce(F.array_min(new["pairs"]), F.lit(_NO_RANK)) < low), merge_one(pieces, pairs, at)).otherwise(new))

        return _let(F.split(F.regexp_replace(marks, "1.", "x-"), ""), marked)

    def step(now: Column) -> Column:
        """Finds the place of the lowest rank, and in the next step merges there; the state serves as the variable in between."""
        pieces, pairs, at = now["pieces"], now["pairs"], now["at"]
        low = F.get(pairs, at - 1)
        again = F.array_position(F.slice(pairs, at + 1, F.size(pairs)), low) > 0
        place = F.array_position(pairs, F.array_min(pairs)).cast("int")
        found = F.when(F.array_min(pairs) == _NO_RANK, state(pieces, none, F.lit(0))).otherwise(state(pieces, pairs, place))
        return F.when(F.size(pairs) == 0, now).when(at == 0, found).when(again, merge_all(pieces, pairs, low, at)).otherwise(merge_one(pieces, pairs, at))

    def fold(letters: Column, pairs: Column) -> Column:
        # The state is copied in every step, so the steps that are left over when all is merged are skipped by the root of their number.
        root = F.sequence(F.lit(1), F.ceil(F.sqrt(2 * F.size(pairs))).cast("int"))
        merged = F.aggregate(root, state(letters, pairs, F.lit(0)), lambda now, _: F.when(F.size(now["pairs"]) == 0, now).otherwise(F.aggregate(root, now, lambda then, __: step(then))))
        return F.transform(F.when(F.size(pairs) == 0, letters).otherwise(merged["pieces"]), rank)

    def parts(whole: Column) -> Column:
        def cut(links: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.octet_length(whole) - 1), lambda i: (i == 0) | F.get(links, i - 1).isNull())

            def folded(first: Column) -> Column:
                def one(start: Column, k: Column) -> Column:
                    end = F.coalesce(F.get(first, k + 1), F.octet_length(whole))
                    letters = F.transform(F.sequence(start + 1, end), lambda i: F.substring(whole, i, F.lit(1)))
                    return _let(letters, lambda own: fold(own, F.slice(links, start + 1, F.size(own) - 1)))

                return F.flatten(F.transform(first, one))

            return _let(starts, folded)

        links = F.transform(F.sequence(F.lit(1), F.octet_length(whole) - 1), lambda i: _lookup(ranks, F.substring(whole, i, F.lit(2))))
        return F.when(F.octet_length(whole) == 1, F.array(rank(whole))).otherwise(_let(links, cut))

    def encode(whole: Column) -> Column:
        return _let(rank(whole), lambda r: F.when(F.octet_length(whole) == 0, F.array().cast(_INTS)).when(r < _NO_RANK, F.array(r)).otherwise(parts(whole)))

    return _let(F.encode(word, "UTF-8"), encode)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def distinct_words(documents: DataFrame, ranks: Column) -> DataFrame:
    """(word, n, ids) of every distinct word of the texts: how often it stands there, and its ids."""
    counted = documents.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # Words are few bytes but long work, so they are spread over all tasks, whatever their size.
    spread = counted.repartition(max(2 * shuffle_partitions(documents.sparkSession), documents.sparkSession.sparkContext.defaultParallelism), "word")
    return spread.select("word", "n", _let(ranks, lambda r: encode_word(F.col("word"), r)).alias("ids"))


def encode_documents(documents: DataFrame, folder: str = VOCABULARIES, name: str = VOCABULARY, literal_words: int = LITERAL_WORDS) -> DataFrame:
    """(doc_id, ids) of every row of documents(doc_id, text), without special tokens; null and empty texts have no ids.

    Strings of special tokens in a text are ordinary text. Repeated and null doc_ids give one row for each of their rows. The result and the number of
    folds are the same for every `literal_words`, 0 included.
    """
    documents = documents.select("doc_id", "text")
    with Literals(documents.sparkSession) as literals:
        ranks = rank_map(literals, read_ranks(folder, name))
        folded = cut_lineage(distinct_words(documents, ranks))
        frequent = folded.filter(F.octet_length("word") <= LITERAL_WORD_BYTES).orderBy(F.desc("n"), "word").limit(literal_words)
        known = literals.table(frequent.select(F.col("word").alias("key"), F.col("ids").alias("value")))
        words = words_of(F.col("text"))
        size = folded.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.octet_length("word") > LITERAL_WORD_BYTES).alias("long")).first()
        if size.n <= literal_words and not size.long:
            # The literal has all words, so there are no occurrences to join.
            return documents.select("doc_id", _let(known, lambda k: F.flatten(F.transform(words, lambda w: _lookup(k, w)))).alias("ids"))
        # -1 stands for a word that the literal has not.
        ids = _let(known, lambda k: F.flatten(F.transform(words, lambda w: F.coalesce(_lookup(k, w), F.array(F.lit(-1))))))
        rest = _let(known, lambda k: F.filter(words, lambda w: _lookup(k, w).isNull()))
        placed = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", ids.alias("ids"))
        staged = cut_lineage(placed.select("row", "doc_id", "ids", F.when(F.array_contains("ids", -1), rest).alias("rest")))
    done = staged.filter("rest is null").select("doc_id", "ids")
    open_ = staged.filter("rest is not null")
    occurrences = open_.select("row", F.posexplode("rest").alias("at", "word"))
    found = occurrences.join(folded.select("word", F.col("ids").alias("word_ids")), "word")
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "word_ids"))).alias("fill"))
    return done.unionByName(open_.join(by_row, "row").select("doc_id", _filled(F.col("ids"), F.col("fill")).alias("ids")))


def _filled(ids: Column, fill: Column) -> Column:
    """`ids` with each -1 replaced by the ids of `fill` in turn."""

    def between(gaps: Column) -> Column:
        def part(gap: Column, k: Column) -> Column:
            before = F.when(k == 0, F.lit(0)).otherwise(F.get(gaps, k - 1) + 1)
            return F.concat(F.slice(ids, before + 1, gap - before), F.get(fill, k)["word_ids"])

        last = F.element_at(gaps, -1)
        return F.concat(F.flatten(F.transform(gaps, part)), F.slice(ids, last + 2, F.size(ids)))

    return _let(F.filter(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: F.get(ids, i) == -1), between)


def decode_documents(encoded: DataFrame, folder: str = VOCABULARIES, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): the pieces as binary, concatenated two by two until one is left; null ids give an empty text.

    Bytes that are no UTF-8 are replaced; an id that is no rank adds nothing.
    """
    spark = encoded.sparkSession
    with Literals(spark) as literals:
        ranked = spark.createDataFrame([(bytearray(p), r) for p, r in read_ranks(folder, name).items()], "piece binary, rank int")
        # Ranks are 0, 1, 2 and so on, so a piece is found by its place.
        in_order = literals.value(ranked.agg(F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("all")).select(F.transform("all", lambda p: p["piece"]).alias("value")))
        nothing = F.lit(b"")
        pieces = _let(in_order, lambda known: F.transform(F.coalesce("ids", F.array().cast(_INTS)), lambda i: F.coalesce(F.get(known, i), nothing)))

        def halve(now: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.ceil((F.size(now) - 2) / 2).cast("int")), lambda i: F.concat(F.get(now, 2 * i), F.coalesce(F.get(now, 2 * i + 1), nothing)))

        rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size("ids") + 1)).cast("int") + 1)
        joined = F.aggregate(rounds, pieces, lambda now, _: F.when(F.size(now) < 2, now).otherwise(halve(now)))
        text = F.when(F.size("ids") > 0, F.decode(F.element_at(joined, 1), "UTF-8")).otherwise(F.lit(""))
        return encoded.select("doc_id", text.alias("text"))
