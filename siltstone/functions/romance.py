"""French, Spanish, Portuguese and Italian by the published Snowball descriptions."""

from __future__ import annotations

from .regions import Stem


def _rv(word: str, vowels: str) -> int:
    """Where the verb region of Spanish, Portuguese and Italian begins."""
    n = len(word)
    if n < 3:
        return n
    if word[1] not in vowels:
        stops = [i for i in range(2, n) if word[i] in vowels]
    elif word[0] in vowels:
        stops = [i for i in range(2, n) if word[i] not in vowels]
    else:
        return 3
    return stops[0] + 1 if stops else n


def _marked(word: str, vowels: str, letters: str) -> str:
    """Letters between vowels, and u after q, in upper case, so that they count as no vowels."""
    out = list(word)
    for i, c in enumerate(word):
        before, after = out[i - 1] if i else "", word[i + 1] if i + 1 < len(word) else ""
        if c == "u" and before == "q" or c in letters and before and after and before in vowels and after in vowels:
            out[i] = c.upper()
    return "".join(out)


# ---------------------------------------------------------------- French

FV = "aeiouyâàëéêèïîôûù"
# Fixed values of the published algorithm.
F_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
F_ATION = "atrice ateur ation atrices ateurs ations".split()
F_I_VERB = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait "
    "issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
F_E_VERB = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
F_A_VERB = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
F_OTHER = (
    "logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement "
    "issements amment emment ment ments"
).split()


def _french_marked(word: str) -> str:
    out = list(_marked(word, FV, "ui"))
    for i, c in enumerate(word):
        near = out[i - 1 : i] + list(word[i + 1 : i + 2]) if i else list(word[1:2])
        if c == "y" and any(x in FV for x in near):
            out[i] = "Y"
    return "".join(out)


def _french_suffix(s: Stem) -> bool:
    """Step 1; true if an ending went that lets no verb ending follow."""
    found = s.within(0, F_PLAIN + F_ATION + F_OTHER)
    base = s.w[: len(s.w) - len(found)] if found else ""
    if found in F_PLAIN:
        return s.drop(found, s.r2)
    if found in F_ATION:
        done = s.drop(found, s.r2)
        if done and not s.drop("ic", s.r2):
            s.drop("ic", new="iqU")
        return done
    if found in ("logie", "logies"):
        return s.drop(found, s.r2, "log")
    if found in ("usion", "ution", "usions", "utions"):
        return s.drop(found, s.r2, "u")
    if found in ("ence", "ences"):
        return s.drop(found, s.r2, "ent")
    if found in ("ement", "ements"):
        if not s.drop(found, s.rv):
            return False
        if s.w.endswith("iv"):
            if s.drop("iv", s.r2):
                s.drop("at", s.r2)
        elif s.w.endswith("eus"):
            if not s.drop("eus", s.r2):
                s.drop("eus", s.r1, "eux")
        elif s.w.endswith(("abl", "iqU")):
            s.drop(s.w[-3:], s.r2)
        elif s.w.endswith(("ièr", "Ièr")):
            s.drop(s.w[-3:], s.rv, "i")
        return True
    if found in ("ité", "ités"):
        if not s.drop(found, s.r2):
            return False
        if s.w.endswith("abil"):
            if not s.drop("abil", s.r2):
                s.drop("abil", new="abl")
        elif s.w.endswith("ic"):
            if not s.drop("ic", s.r2):
                s.drop("ic", new="iqU")
        else:
            s.drop("iv", s.r2)
        return True
    if found in ("if", "ive", "ifs", "ives"):
        if not s.drop(found, s.r2):
            return False
        if s.drop("at", s.r2) and s.w.endswith("ic") and not s.drop("ic", s.r2):
            s.drop("ic", new="iqU")
        return True
    if found == "eaux":
        return s.drop("eaux", new="eau")
    if found == "aux":
        return s.drop("aux", s.r1, "al")
    if found in ("euse", "euses"):
        return s.drop(found, s.r2) or s.drop(found, s.r1, "eux")
    if found in ("issement", "issements"):
        return bool(base) and base[-1] not in FV and s.drop(found, s.r1)
    if found in ("amment", "emment"):
        s.drop(found, s.rv, "ant" if found == "amment" else "ent")
    elif found and base[s.rv :] and base[-1] in FV:
        s.drop(found)
    return False


def _french_verb(s: Stem) -> bool:
    """Steps 2a and 2b."""
    found = s.within(s.rv, F_I_VERB)
    base = s.w[s.rv : len(s.w) - len(found)]
    if found and base and base[-1] not in FV:
        return s.drop(found)
    found = s.within(s.rv, ["ions", *F_E_VERB, *F_A_VERB])
    if found == "ions":
        return s.drop(found, s.r2)
    if s.drop(found) and found in F_A_VERB:
        s.drop("e", s.rv)
    return bool(found)


def french(word: str) -> str:
    w = _french_marked(word)
    if w[:3] in ("par", "col", "tap") or len(w) > 1 and w[0] in FV and w[1] in FV:
        rv = min(3, len(w))
    else:
        rv = next((i + 1 for i, c in enumerate(w) if i and c in FV), len(w))
    s = Stem(w, FV, rv)
    if _french_suffix(s) or _french_verb(s):
        s.drop("Y", new="i") or s.drop("ç", new="c")
    else:
        if s.w.endswith("s") and len(s.w) > 1 and s.w[-2] not in "aiouès":
            s.drop("s")
        found = s.within(s.rv, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"))
        if found == "ion":
            if s.w[s.rv : -3][-1:] in ("s", "t"):
                s.drop("ion", s.r2)
        elif found == "ë":
            if s.w[s.rv : -1].endswith("gu"):
                s.drop("ë")
        elif found:
            s.drop(found, new="" if found == "e" else "i")
    if s.w.endswith(("enn", "onn", "ett", "ell", "eill")):
        s.w = s.w[:-1]
    end = len(s.w.rstrip("".join(set(s.w) - set(FV)))) if s.w else 0
    if 0 < end < len(s.w) and s.w[end - 1] in "éè":
        s.w = s.w[: end - 1] + "e" + s.w[end:]
    return s.w.lower()


# ---------------------------------------------------------------- Spanish

SV = "aeiouáéíóúü"
# Fixed values of the published algorithm.
S_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
S_PLAIN = (
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
).split()
S_ACION = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
S_Y_VERB = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
S_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá "
    "eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an "
    "aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis "
    "abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
S_OTHER = "logía logías ución uciones encia encias amente mente idad idades iva ivo ivas ivos".split()
ACUTE = str.maketrans("áéíóú", "aeiou")


def _adverb(s: Stem, inner: tuple[str, ...]) -> bool:
    """amente: what stands before it goes too."""
    if not s.drop("amente", s.r1):
        return False
    if s.drop("iv", s.r2):
        s.drop("at", s.r2)
    else:
        s.drop_any(inner, s.r2)
    return True


def _followed(s: Stem, suffix: str, inner: tuple[str, ...]) -> bool:
    """Drop an ending and then one of those that may stand before it, both in R2."""
    done = s.drop(suffix, s.r2)
    if done:
        s.drop_any(inner, s.r2)
    return done


def _spanish_suffix(s: Stem) -> bool:
    found = s.within(0, S_PLAIN + S_ACION + S_OTHER)
    if found in S_PLAIN:
        return s.drop(found, s.r2)
    if found in S_ACION:
        return _followed(s, found, ("ic",))
    if found.startswith("log"):
        return s.drop(found, s.r2, "log")
    if found in ("ución", "uciones"):
        return s.drop(found, s.r2, "u")
    if found in ("encia", "encias"):
        return s.drop(found, s.r2, "ente")
    if found == "amente":
        return _adverb(s, ("os", "ic", "ad"))
    if found == "mente":
        return _followed(s, found, ("ante", "able", "ible"))
    if found in ("idad", "idades"):
        return _followed(s, found, ("abil", "ic", "iv"))
    return _followed(s, found, ("at",))


def _spanish_verb(s: Stem) -> None:
    found = s.within(s.rv, S_Y_VERB)
    if found and s.w[: len(s.w) - len(found)].endswith("u"):
        s.drop(found)
        return
    found = s.within(s.rv, ["en", "es", "éis", "emos", *S_VERB])
    if s.drop(found) and found in ("en", "es", "éis", "emos") and s.w.endswith("gu"):
        s.drop("u")


def spanish(word: str) -> str:
    s = Stem(word, SV, _rv(word, SV))
    found = s.within(0, S_PRONOUNS)
    if found:
        base = s.w[: len(s.w) - len(found)]
        verb = Stem(base, SV, s.rv).within(0, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if verb and len(base) - len(verb) >= s.rv and len(s.w) - len(found) >= s.rv and (verb != "yendo" or base[: -len(verb)].endswith("u")):
            s.w = base[: len(base) - len(verb)] + verb.translate(ACUTE)
    if not _spanish_suffix(s):
        _spanish_verb(s)
    found = s.within(s.rv, ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if s.drop(found) and found in ("e", "é") and s.w.endswith("gu"):
        s.drop("u", s.rv)
    return s.w.translate(ACUTE)


# ---------------------------------------------------------------- Portuguese

PV = "aeiouáéíóúâêô"
# Fixed values of the published algorithm; a~ and o~ stand for ã and õ.
P_PLAIN = (
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o "
    "adoras adores aço~es ante antes ância"
).split()
P_VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam "
    "aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias "
    "arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais "
    "eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos "
    "eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou "
    "ira iras"
).split()
P_OTHER = "logia logias uça~o uço~es ência ências amente mente idade idades iva ivo ivas ivos ira iras".split()


def _portuguese_suffix(s: Stem) -> bool:
    found = s.within(0, P_PLAIN + P_OTHER)
    if found in P_PLAIN:
        return s.drop(found, s.r2)
    if found.startswith("log"):
        return s.drop(found, s.r2, "log")
    if found in ("uça~o", "uço~es"):
        return s.drop(found, s.r2, "u")
    if found in ("ência", "ências"):
        return s.drop(found, s.r2, "ente")
    if found == "amente":
        return _adverb(s, ("os", "ic", "ad"))
    if found == "mente":
        return _followed(s, found, ("ante", "avel", "ível"))
    if found in ("idade", "idades"):
        return _followed(s, found, ("abil", "ic", "iv"))
    if found in ("ira", "iras"):
        return s.w[: len(s.w) - len(found)].endswith("e") and s.drop(found, s.rv, "ir")
    return _followed(s, found, ("at",))


def portuguese(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    s = Stem(w, PV, _rv(w, PV))
    if _portuguese_suffix(s) or s.drop(s.within(s.rv, P_VERB)):
        if s.w.endswith("ci"):
            s.drop("i", s.rv)
    else:
        s.drop(s.within(s.rv, ("os", "a", "i", "o", "á", "í", "ó")))
    if s.drop(s.within(s.rv, ("e", "é", "ê"))):
        if s.w.endswith(("gu", "ci")):
            s.drop(s.w[-1], s.rv)
    else:
        s.drop("ç", new="c")
    return s.w.replace("a~", "ã").replace("o~", "õ")


# ---------------------------------------------------------------- Italian

IV = "aeiouàèìòù"
# Fixed values of the published algorithm.
I_PRONOUNS = (
    "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene "
    "cela cele celi celo cene vela vele veli velo vene"
).split()
I_PLAIN = (
    "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente "
    "atrice atrici ante anti"
).split()
I_VERB = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà "
    "erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo "
    "iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco "
    "iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
).split()
I_OTHER = (
    "azione azioni atore atori logia logie uzione uzioni usione usioni enza enze amento amenti imento imenti amente ità ivo ivi iva ive"
).split()


def _italian_suffix(s: Stem) -> bool:
    found = s.within(0, I_PLAIN + I_OTHER)
    if found in I_PLAIN:
        return s.drop(found, s.r2)
    if found in ("azione", "azioni", "atore", "atori"):
        return _followed(s, found, ("ic",))
    if found.startswith("log"):
        return s.drop(found, s.r2, "log")
    if found in ("uzione", "uzioni", "usione", "usioni"):
        return s.drop(found, s.r2, "u")
    if found in ("enza", "enze"):
        return s.drop(found, s.r2, "ente")
    if found in ("amento", "amenti", "imento", "imenti"):
        return s.drop(found, s.rv)
    if found == "amente":
        return _adverb(s, ("os", "ic", "abil"))
    if found == "ità":
        return _followed(s, found, ("abil", "ic", "iv"))
    done = s.drop(found, s.r2)
    if done and s.drop("at", s.r2):
        s.drop("ic", s.r2)
    return done


def italian(word: str) -> str:
    w = _marked(word.translate(str.maketrans("áéíóú", "àèìòù")), IV, "ui")
    s = Stem(w, IV, _rv(w, IV))
    found = s.within(0, I_PRONOUNS)
    if found:
        base = s.w[: len(s.w) - len(found)]
        if base[s.rv :].endswith(("ando", "endo")):
            s.w = base
        elif base[s.rv :].endswith(("ar", "er", "ir")):
            s.w = base + "e"
    if not _italian_suffix(s):
        s.drop(s.within(s.rv, I_VERB))
    if s.drop(s.within(s.rv, "aeioàèìò")):
        s.drop("i", s.rv)
    if s.w[s.rv :].endswith(("ch", "gh")):
        s.w = s.w[:-1]
    return s.w.lower()
