"""Stopwords that come with the package."""

from __future__ import annotations

# Public lists, each in its own order.
STOPWORDS = {
    # English, after the list of the Snowball stemmer.
    "eng": """
i me my myself we us our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing will would shall should can could may must might
ought isn aren wasn weren hasn haven hadn doesn don didn won wouldn shan shouldn cannot couldn mustn let a an
the and but if or because as until while of at by for with about against between into through during before
after above below to from up down in out on off over under again further then once here there when where why
how all any both each few more most other some such no nor not only own same so than too very
""".split(),
    # Latin, after the list of the Perseus project.
    "lat": """
ab ac ad adhic aliqui aliquis an ante apud at atque aut autem cum cur de deinde dum ego enim ergo es est et
etiam etsi ex fio haud hic iam idem igitur ille in infra inter interim ipse is ita magis modo mox nam ne nec
necque neque nisi non nos o ob per possum post pro quae quam quare qui quia quicumque quidem quilibet quis
quisnam quisquam quisque quisquis quo quoniam sed si sic sive sub sui sum super suus tam tamen trans tu tum
ubi uel uero unus ut
""".split(),
    # Swedish, after the list of NLTK.
    "swe": """
och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då
sin nu har inte hans honom skulle hennes där min man ej vid kunde något från ut när efter upp vi dem vara vad
över än dig kan sina här ha mot alla under någon eller allt mycket sedan ju denna själv detta åt utan varit
hur ingen mitt ni bli blev oss din dessa några deras blir mina samma vilken er sådan vår blivit dess inom
mellan sådant varför varje vilka ditt vem vilket sitta sådana vart dina vars vårt våra ert era vilkas
""".split(),
}
#: Languages whose longer lists must be given as a table or file.
GIVEN = ("ger",)


def stopwords(lang: str | None) -> list[str]:
    """The words of a language; None gives none, a language without a list raises."""
    if lang is None:
        return []
    if lang not in STOPWORDS:
        raise ValueError(f"no stopwords for {lang} in the package" + ("; give them as a table or file" if lang in GIVEN else ""))
    return STOPWORDS[lang]
