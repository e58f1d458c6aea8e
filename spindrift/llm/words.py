"""Fixed word lists shared by the text operators."""

from __future__ import annotations

#: Closed-class words by language (fixed values): articles, pronouns, prepositions, conjunctions, auxiliaries.
CLOSED = {
    "en": (
        "the of a an and is are was in to that we this with for by it do not you can be on at or as may must which has have "
        "each our will after every i my me she he they them his her its so but because how why between before where from any "
        "when while today now let most people should both neither nor those who within if than then there their your into"
    ).split(),
    "de": "der die das den dem des und ist sind ein eine einen einem in im zu mit auf für von nicht man ohne heute jede jeder niemand wir sie es er als auch bei aus nach wie".split(),
    "es": "el la los las un una de del y es son en que se por con para sin no cada su al lo como más o quién qué".split(),
    "fr": "le la les un une des du de et est sont en que qui dans pour par sur avec sans ne pas chaque ce cette il elle on nous vous au aux".split(),
}
