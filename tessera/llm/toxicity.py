"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding decomposes accents and compatibility letters, lower-cases, replaces
look-alike letters of other scripts and digits or signs that stand for
letters, joins spaced letters, and leaves one space between words.  The
lexicon is learnt: word beginnings and whole words that occur in toxic
labelled documents far more often than in clean ones get the log of that
ratio as weight, and words that begin like a toxic one but occur in clean
documents become exceptions, beside given exception phrases.  An automaton
finds all terms in one pass over a text; the hits inside exceptions are
dropped, each word counts with its largest weight, and the sums enter
divided by the text's length.  A logistic regression on these few numbers
gives the score.

Only the fit is bounded: it reads at most ``sample`` labelled documents (the
smallest by a hash of their id), and the lexicon holds only terms found in at
least ``min_share`` of the toxic ones, which bounds its size.  Every document
is scored.

Defined cases: null and empty texts have no hits and get the score of a text
without any; without labels of both kinds every score is 0; labels with a
null id or null mark are left out, and of repeated labels the larger counts.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import literal_table, ship, written

ship(__name__)

SAMPLE = 20_000
MIN_SHARE = 0.01
MIN_DOCUMENTS = 3
MIN_WEIGHT = 2.5
LIMIT = 0.3
PREFIXES = range(4, 11)

#: Letters of other scripts and small capitals that look like Latin letters (Cyrillic, Greek, Armenian, phonetic).
LOOK_ALIKE = dict(zip("авекмнорстухіјѕԁԛԝһӏґ", "abekmhopctyxijsdqwhlr")) | dict(zip("αβγεηικνορσςτυχωϲϳ", "abyenikvopostuxwcj")) | dict(
    zip("օսհոցաԼ", "ouhnqwl")) | dict(zip("ɡıȷʙɢʜɪʟɴʀʏᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢ", "gijbghilnryacdejkmoptuvwz"))
#: Digits and signs used for letters.
DIGITS = dict(zip("013457@$", "oieastas"))
_FOLD = str.maketrans({**LOOK_ALIKE, **DIGITS})
_BREAK = re.compile(r"[\W_]+")
#: Marks that stand above, below or through a letter.
_MARK = re.compile(r"[\u0300-\u036f\u200b-\u200f\u2060\ufeff\u00ad]+")
_SPACED = re.compile(r"(?<= )(?:\w ){2,}\w(?= )")
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "moron river")


def folded(text: str) -> str:
    """Folded words between single spaces, with a space at both ends.

    Compatibility forms (full-width, bold or circled letters) and accents are decomposed by Unicode's own rule and the
    marks dropped; then look-alike letters, digits and signs are replaced; single letters in a row are one word."""
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text))
    text = f" {_BREAK.sub(' ', text.lower().translate(_FOLD)).strip()} "
    return _SPACED.sub(lambda m: m.group().replace(" ", ""), text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows (doc_id, toxic) that the fit may see."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return (rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))


def _word_counts(texts: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many documents of either kind a folded word occurs."""
    def work(frames):
        for frame in frames:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(frame["text"], frame["toxic"]):
                for w in set(folded(text).split()):
                    counts.setdefault(w, [0, 0])[0 if toxic else 1] += 1
            yield pd.DataFrame([(w, a, b) for w, (a, b) in counts.items()], columns=["word", "toxic", "clean"])

    return texts.mapInPandas(work, "word string, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(docs: DataFrame, train: DataFrame, min_share: float = MIN_SHARE) -> dict[str, float]:
    """Weights of terms: `` begin`` matches words that begin so, `` word `` the word alone; weight 0 is an exception.

    ``train`` is the bounded set of labels."""
    sizes = train.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.count(F.lit(1))).first()
    n_toxic, n_clean = int(sizes[0] or 0), int(sizes[1]) - int(sizes[0] or 0)
    if not n_toxic or not n_clean:
        return {}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(train), "doc_id")
    words = written(_word_counts(texts.select("text", "toxic")), "words")
    least = max(MIN_DOCUMENTS, math.ceil(min_share * n_toxic))

    def weight(toxic: Column, clean: Column) -> Column:
        return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))

    begins = words.select("toxic", "clean", F.explode(F.array(*[
        F.when(F.length("word") >= k, F.concat(F.lit(" "), F.substring("word", 1, k))) for k in PREFIXES],
        F.concat(F.lit(" "), "word", F.lit(" ")))).alias("term")).where("term is not null")
    terms = begins.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).select(
        "term", "toxic", weight(F.col("toxic"), F.col("clean")).alias("weight")).where(
        (F.col("toxic") >= least) & (F.col("weight") >= MIN_WEIGHT))
    lexicon = {r["term"]: round(r["weight"], 6) for r in terms.select("term", "weight").collect()}
    if lexicon:
        # Words that begin like a term but are at home in clean documents.
        starts = [t for t in lexicon if not t.endswith(" ")]
        known = literal_table(words.sparkSession, [dict(begin=t[1:]) for t in starts], "begin string")
        if starts:
            harmless = words.where(f"clean >= {MIN_DOCUMENTS} and clean > toxic").select(
                "word", F.explode(F.array(*[F.substring("word", 1, k) for k in PREFIXES])).alias("begin")).join(
                F.broadcast(known), "begin").select("word").distinct()
            lexicon.update({f" {r['word']} ": 0.0 for r in harmless.collect()})
    return lexicon


def measures(lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
    """A pandas UDF text -> (hits, weight, words)."""
    terms = sorted(lexicon.items())
    phrases = [f" {p} " for p in exceptions]

    @F.pandas_udf("hits double, weight double, words double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in terms:
            automaton.add_word(term, (len(term), weight))
        for phrase in phrases:
            automaton.add_word(phrase, (len(phrase), -1.0))
        if terms or phrases:
            automaton.make_automaton()
        rows = []
        for text in texts:
            text = folded(text or "")
            best, spared = {}, []
            for end, (size, weight) in automaton.iter(text) if len(automaton) else ():
                at = end - size + 1
                if weight < 0:
                    spared.append((at, end))
                elif weight == 0:
                    spared.append((at, at + 1))
                else:
                    best[at] = max(weight, best.get(at, 0.0))
            for a, b in spared:
                for at in [x for x in best if a <= x < b] if b > a + 1 else [a]:
                    best.pop(at, None)
            rows.append((float(len(best)), sum(best.values()), float(max(1, text.count(" ") - 1))))
        return pd.DataFrame(rows, columns=["hits", "weight", "words"])

    return measured


def _features(m: str) -> list[Column]:
    return [F.log1p(F.col(f"{m}.hits")).alias("f0"), (F.col(f"{m}.weight") / (F.col(f"{m}.words") + 20)).alias("f1"),
            F.least(F.col(f"{m}.hits"), F.lit(2.0)).alias("f2")]


class ToxicityModel:
    """A lexicon and the few numbers of a logistic regression."""

    def __init__(self, lexicon: dict[str, float], weights: list[float], bias: float, fitted: bool):
        self.lexicon, self.weights, self.bias, self.fitted = lexicon, weights, bias, fitted
        self.udf = measures(lexicon)

    def score(self, measured: str) -> Column:
        if not self.fitted:
            return F.lit(0.0)
        z = F.lit(self.bias)
        for w, f in zip(self.weights, _features(measured)):
            z = z + F.lit(w) * f
        return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learns from labelled rows that are not held out."""
    train = written(training_labels(labels, sample), "train")
    lexicon = learn_lexicon(docs, train)
    if not lexicon:
        return ToxicityModel({}, [], 0.0, False)
    texts = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id")
    rows = texts.select(F.col("toxic").cast("double").alias("label"), measures(lexicon)("text").alias("m"))
    rows = written(rows.select("label", *_features("m")), "features")
    assembled = VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="features").transform(rows)
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(assembled)
    return ToxicityModel(lexicon, [float(x) for x in model.coefficients], float(model.intercept), True)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    rows = docs.select("doc_id", model.udf("text").alias("m")).select("doc_id", model.score("m").alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                       F.when(F.col("score") >= LIMIT, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows that are not predicted toxic, unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), model.udf("text").alias("m"))
    judged = rows.select("row", (model.score("m") < LIMIT).alias("clean"))
    return judged.select(F.explode(F.when(F.col("clean"), F.array("row"))).alias("row")).select("row.*")
