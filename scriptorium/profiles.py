"""Languages as data: what the text rules need to know of each."""

from __future__ import annotations

from dataclasses import dataclass

# Letters, word lists and limits that results depend on.
PUNCTUATION = ".,;:!?\"'()[]{}«»—–-‘’“”"
ENGLISH = tuple(
    "the and that with from this they have been which would could should about there their what when where while because between through above "
    "after before under over into onto off out up down only also even more less most least very much many some such than then them these those does "
    "did doing done being having will shall might must can may of in on at to is it as be by or if so we us our you your he she his her its but not no "
    "yes one two three four five six seven eight nine ten".split()
)
MARKERS = {
    "ltz": tuple("an de eng een duerch vun mat op fir gëtt sinn hunn wier wor nët net och wéi dësem dëst dës hei do wann haut muer gëschter keng kee sengem senger hirem hirer vläicht".split()),
    "fr": tuple("le la les de et dans des une un que qui pour avec sur par est sont".split()),
    "de": tuple("der die das und ist sind eine ein nicht auch wie wenn aber mit auf für".split()),
}
ARTICLES = tuple("il id is it in ir ix iz l fil fis fit fid fl bil bis bit bid tal tas tat tad min mil mis mit".split())
#: Clitics behind whose hyphen a stray blank is noise.
CLITIC_ARTICLES = tuple(
    "il is id it in ir ix iz iż fis fil fid fit fix fl bil bis bid bit bix biż mil mis mid mit mix miż tal tas tad tat tax taż sal sas sad sat sax ġos għax għal għall sa ma kull lil biex bħal l".split()
)
LATIN = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"


@dataclass(frozen=True)
class Language:
    """canaries: letters a recogniser tends to lose; fold, to: their plain forms; articles: prefixes that put a text in its bucket; clitics: those that the normaliser knows."""

    name: str
    canaries: str
    fold: str
    to: str
    articles: tuple[str, ...] = ()
    clitics: tuple[str, ...] = ()


MALTESE = Language("mt", "ċġħżĊĠĦŻ", "ħĦġĠċĊżŻ", "hHgGcCzZ", ARTICLES, CLITIC_ARTICLES)
GENERIC = Language("latin", LATIN, LATIN, "ACEEEINOOUsaceeeinoou")
