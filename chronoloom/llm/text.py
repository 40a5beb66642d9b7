"""Shared text expressions: words, languages, and skeletons that ignore names and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: frequent function words by language
FUNCTION_WORDS = {
    "en": "the of and is are was in on to for with this that by at from a an as it be which than what does have not but can has will there first such i".split(),
    "de": "der die das und ist sind wird wurde nicht ein eine mit auf für von zu den dem des im bei keine kein daher auch dort bleibt über zeigt ableitung ableitungen aufzeichnung sehen befund wert liegt welche welcher wie gibt nach was gegen es sich".split(),
    "fr": "le la les et est sont une un des du dans pour avec que qui ne pas sur au en ce cette cet par plus quel quelles donc où se montre reste voit dérivation dérivations tracé montrent montre-t-il d'environ a été aucune après l'intervalle".split(),
    "es": "el los las y es son una un del para con que no se por en como más este esta qué cuánto donde lo al también de unos su ningún queda muestra hay está presente derivación derivaciones hallazgo registro trazado".split(),
}
ZERO_WIDTH = r"[\u00ad\u180e\u200b-\u200f\u2060-\u2064\ufeff]+"  #: no width: they can stand inside a word
BLANK = r"[\s\u00a0\u2000-\u200a\u2028-\u202f\u205f\u3000]+"
LEADS = r"\b(avr|avl|avf|v[1-6]|iii|ii|i)\b"


def squeeze(text: Column) -> Column:
    """Without characters of no width; runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), ZERO_WIDTH, ""), BLANK, " "))


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, with inner apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*)"))


def skeleton(text: Column) -> Column:
    """Lower-case text with leads and numbers replaced by marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9]+(?:[.,][0-9]+)*", "#"), LEADS, "§")


def language_votes(tokens: Column) -> Column:
    """A struct of the counts of function words per language. Words of several languages count for each."""
    def count(own: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*own)))

    return F.struct(*[count(own).alias(k) for k, own in FUNCTION_WORDS.items()])


def language(tokens: Column, least: int = 2) -> Column:
    """The language with the most function words; null with fewer than ``least`` or a tie."""
    v = language_votes(tokens)
    counts = {k: v[k] for k in FUNCTION_WORDS}
    top = F.greatest(*counts.values())
    ties = sum((F.when(c == top, 1).otherwise(0) for c in counts.values()), F.lit(0))
    best = F.coalesce(*[F.when(c == top, F.lit(k)) for k, c in counts.items()])
    return F.when((top >= least) & (ties == 1), best)
