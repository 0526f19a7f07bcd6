import pytest
from hypothesis import given
from hypothesis import strategies as st

from siltstone.functions.stemmers import LANGUAGES, STEMMERS

#: A word and its stem in turn, recalled from the published samples.
SAMPLES = {
    "french": (
        "continu continu continua continu continuait continu continuant continu continuation continu continuellement "
        "continuel majestueusement majestu majestueux majestu majesté majest majeur majeur majorité major mal mal "
        "malade malad maladie malad malheureusement malheur malheureux malheur main main maintenant mainten maintenir "
        "mainten chevaux cheval journaux journal"
    ),
    "spanish": (
        "cheque chequ cheques chequ chicas chic chicharrones chicharron chico chic chilena chilen torear tor torneo "
        "torne torneos torne toros tor torturado tortur trabajar trabaj torrencial torrencial torpedearon torped"
    ),
    "portuguese": (
        "boa boa boas boas bobagem bobag bobagens bobagens bocadas boc boiar boi boatos boat bons bons quilombo quilomb"
        " quinhentos quinhent quietos quiet"
    ),
    "italian": (
        "abbandonata abbandon abbandonare abbandon abbandonò abbandon abbaruffato abbaruff abbassamento abbass "
        "abbellire abbell pronto pront pronuncia pronunc propaganda propagand pronunciamento pronunc"
    ),
    "dutch": (
        "lichaam licham lichaamsziekten lichaamsziekt lichamelijk licham lichamelijke licham lichamelijkheden licham "
        "lichten licht opglimlachten opglimlacht ophaalt ophaalt opheffen opheff opheffende opheff opheffing opheff "
        "opgingen opging opgroeien opgroei"
    ),
    "russian": (
        "вавиловка вавиловк вагнера вагнер вагон вагон вагоне вагон важная важн важнейшие важн важничал важнича "
        "важности важност важностию важност валандался валанда вали вал валился вал валиться вал пальто пальт падать "
        "пада"
    ),
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_published_samples(language):
    words = SAMPLES[language].split()
    assert [STEMMERS[language](w) for w in words[::2]] == words[1::2]


@pytest.mark.parametrize("language", LANGUAGES)
@given(word=st.text("aeiouyéèàíóúâêãõçñsntrlmgdqkhvbwjäöüßåæøабвгеийлмностшщьыюяё~'", max_size=12))
def test_any_word_has_a_stem(language, word):
    found = STEMMERS[language](word)
    assert len(found) <= len(word) + 3 and STEMMERS[language](word) == found
