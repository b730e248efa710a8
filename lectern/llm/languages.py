"""Language votes by stop words, for the four languages of the corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent function words; words common to two of the languages are left out of both.
STOPWORDS = {
    "de": "aber als am auch auf aus bei bleibt dann das dass dem den der des die durch ein eine einen einer es für ihr im ist ist kein mit nach nicht noch oder ohne sich sie sind über und unter vom von war was weil welche wenn wie wir wird zu zum zur",
    "en": "although and are at because been but by each for from had has have he how in into is it its more most neither nor not of on only or over she that the their then there these they this those through to under was were what when where which while who why with without",
    "es": "al como con cual cuando de del dos el ella en entre eran es esta este está la las lo los más muy no nos otro para pero por porque qué que se sea ser si sin sobre son su sus también una ya y",
    "fr": "alors au aussi aux avec bien car ce ces cette chez dans de des du elle elles en entre est et être il ils la le les leur lorsque mais montre ne ni nous ou par pas plus pour quand quel quelle qui sa sans se ses son sont sous sur une vous",
}


def _own(lang: str) -> list[str]:
    others = {w for k, v in STOPWORDS.items() if k != lang for w in v.split()}
    return sorted(set(STOPWORDS[lang].split()) - (others if lang != "x" else set()))


#: Votes count words that belong to one language alone.
VOTES = {k: _own(k) for k in STOPWORDS}


def votes(tokens: Column, lang: str) -> Column:
    """How many of the (lower-case) tokens are function words of this language alone."""
    return F.size(F.filter(tokens, lambda w: w.isin(*VOTES[lang])))


def winner(**counts: Column) -> Column:
    """Language with most votes, earlier name on ties; NULL without any vote."""
    best = F.array_max(F.array(*[F.struct(c.cast("long").alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("lang")) for i, (k, c) in enumerate(sorted(counts.items()))]))
    return F.when(best["n"] > 0, best["lang"])
