"""A small labelled URL table, made by rule from two public kinds of words.

Blocked are names by the categories that public filter lists of the web have
(gambling, adult content, quack medicine, advertising, piracy, fraud), a few
everyday words each. Clean are names from the English word lists of this
library, closed-class words included, and from the subjects of a public
library. Neither is drawn from any table that the filter is run on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions.lexicon import ENGLISH

# Words by category of public filter lists.
BLOCKED = {
    "gambling": "casino casinos poker roulette blackjack baccarat jackpot lottery lotto betting bets bet bookmaker slots gambling wager odds bingo dice spins",
    "adult": "adult porn porno xxx sex sexy nude naked escort escorts erotic hentai cams webcam dating hookup fetish milf",
    "medicine": "viagra cialis levitra pills pill pharmacy meds steroid steroids painkiller tramadol xanax diet slimming weightloss",
    "advertising": "ads ad adserver adclick banner banners popup popunder tracker tracking clickbait doubleclick affiliate spam bulkmail traffic",
    "piracy": "warez crack cracked keygen serial torrent torrents nulled leech rapidshare cam-rip iptv free-download",
    "fraud": "phishing malware scam payday loan loans quickcash forex bitcoin crypto replica counterfeit cheap discount giveaway winner prize",
}
# Subjects of a public library.
SUBJECTS = (
    "news blog wiki docs library museum university school college research science journal weather sports travel recipes "
    "music books history health garden photo code forum support help shop store city council archive press radio theatre "
    "station nature river mountain house education student teacher open project tools data maps world local art law "
    "language poetry physics chemistry biology geology painting cooking sewing farming sailing railway bridge castle church"
).split()
SECOND = "site online hub zone central now direct daily".split()
PATHS = "/ /index.html /a/b /post/5 /en/1 /de/2/ /fr/3.html /es/4 /about /news/2020/01/item.html".split()
TOP = "com org net info".split()


def words() -> list[tuple[str, int]]:
    blocked = sorted({w for ws in BLOCKED.values() for w in ws.split()})
    clean = {w for ws in ENGLISH.words().values() for w in ws if len(w) > 2} | set(SUBJECTS)
    return [(w, 1) for w in blocked] + [(w, 0) for w in sorted(clean - set(blocked))]


def _pick(words: list[str], salt: int) -> F.Column:
    table = F.array(*map(F.lit, words))
    return F.element_at(table, (F.pmod(F.xxhash64("word", "variant", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))


def labelled_urls(spark: SparkSession, without: tuple[str, ...] = (), blocked: int = 5, clean: int = 4) -> DataFrame:
    """(url, label, word): each word, but those in ``without``, alone or beside
    a second word, with some sub-domains, tops and paths."""
    given = [F.struct(F.lit(w).alias("word"), F.lit(label).alias("label")) for w, label in words() if w not in without]
    rows = spark.range(1).select(F.inline(F.array(*given)))
    count = F.when(F.col("label") == 1, F.lit(blocked)).otherwise(F.lit(clean))
    rows = rows.withColumn("variant", F.explode(F.sequence(F.lit(1), count)))
    pair = (
        F.when(F.col("variant") % 3 == 0, F.col("word"))
        .when(F.col("variant") % 3 == 1, F.concat_ws("-", "word", _pick(SECOND, 1)))
        .otherwise(F.concat_ws("-", _pick(SECOND, 2), "word"))
    )
    host = F.concat(_pick(["", "www.", "m.", "blog."], 3), pair, F.lit("."), _pick(["", "example."], 4), _pick(TOP, 5))
    return rows.select(F.concat(F.lit("https://"), host, _pick(PATHS, 6)).alias("url"), "label", "word")
