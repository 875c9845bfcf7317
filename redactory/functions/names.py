"""Personal names for the light name detector, and the place of a recogniser for the full one.

The list built in holds common given names and surnames in public knowledge; it is small. ``sources.files.read_names``
reads larger ones (census tables and the like) for a policy's ``names``. A named-entity model plugs in as a policy's
``recogniser``, batches of texts in, spans out, or for one process by ``set_recogniser``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

# Titles and suffixes of names.
SUFFIXES = ("Jr.", "Sr.", "II", "III", "IV")
TITLE = r"(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s*"
SUFFIX = r"(?:Jr\.|Sr\.|II|III|IV)$"

GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen daniel matthew anthony mark donald steven paul andrew joshua kenneth nancy lisa betty margaret sandra ashley emily donna michelle carol amanda "
    "maria jose juan carlos ana luis marie jean pierre hans anna peter jane alice bob emma olivia noah liam sophia lucas mia".split()
)
SURNAMES = frozenset(
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson taylor moore jackson martin lee perez thompson white harris sanchez clark ramirez lewis robinson walker young allen king wright scott torres nguyen hill flores "
    "doe müller schmidt schneider fischer weber dubois bernard rossi russo ferrari silva santos kim wang chen".split()
)
STOPWORDS = frozenset("the a an and or of in on at to for by with from new north south east west great united street avenue road city may june april august king young white hill brown".split())

_recogniser: Callable[[str], Iterable[tuple[int, int]]] | None = None


def known(word: str, more: frozenset[str] = frozenset()) -> bool:
    return word in GIVEN or word in SURNAMES or word in more


def set_recogniser(find: Callable[[str], Iterable[tuple[int, int]]] | None) -> None:
    """A recogniser for this process, one text a call; a policy's recogniser goes before it and reaches all executors."""
    global _recogniser
    _recogniser = find


class Recognised:
    """What a policy's recogniser found in the texts of the batch at hand: asked once a batch, looked up text by text."""

    def __init__(self) -> None:
        self.spans: dict[str, list[tuple[int, int]]] = {}

    def ask(self, recogniser: Callable[[list[str]], Sequence[Iterable[tuple[int, int]]]], texts: Iterable[str | None]) -> None:
        asked = list(dict.fromkeys(t for t in texts if t))
        self.spans = {t: [tuple(s) for s in spans] for t, spans in zip(asked, recogniser(asked) if asked else [], strict=True)}


BATCH = Recognised()


def recogniser() -> Callable[[str], Iterable[tuple[int, int]]]:
    if BATCH.spans:
        return lambda text: BATCH.spans.get(text, ())
    if _recogniser is None:
        raise RuntimeError("person_name needs a named-entity recogniser: give the policy one, or call names.set_recogniser")
    return _recogniser
