"""Text that was decoded with the wrong character encoding: found, and restored where possible.

The garbled form of every character of a repertoire is computed for all encoding pairs, and one
Aho-Corasick automaton finds them all in one pass.  The sequences of the other assigned characters (CJK,
Hebrew, Arabic, combining marks and so on) are too many to list: they are matched by the classes of lead and
continuation bytes.  Two families of pairs exist:

* UTF-8 bytes read as a single-byte encoding: each character becomes a sequence of two to four, which is
  evidence in itself.  Matched spans are encoded back and decoded as UTF-8, again and again while
  garbling remains (text garbled twice or more).
* A single-byte encoding read as another: one character for one, so only runs are evidence.
  The automaton has the garbled forms of frequent letter pairs; a line with hits is restored if the
  letters of the restored runs are far likelier in the language than those that stand there.
  For the encodings of Western and Central Europe, where most letters of a word are ASCII, words are read
  with each pair: evidence are words that no language has and that become likely ones, and frequent words.

Only matched spans are replaced.  U+FFFD, and ``?`` inside words, show that characters were lost: such
documents are found, but those places can't be restored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm import scripts
from quarry.sources.tables import spread

# Encodings that text is wrongly read as, and pairs (true, wrong) of Cyrillic encodings.
WRONG = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-2", "cp866", "koi8-r", "mac_latin2", "cp1253", "cp1254", "cp852"]
SINGLE = ["cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"]
SINGLE_WRONG = ["cp1251", "koi8-r", "cp866", "cp1252", "latin-1", "cp1250", "cp437", "cp850", "mac_roman", "iso8859-5", "mac_cyrillic"]
# Blocks whose characters texts use: Latin, Greek, Cyrillic, punctuation, symbols, box drawing, kana.
BLOCKS = [(0x80, 0x250), (0x370, 0x460), (0x2010, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2200), (0x2200, 0x2270), (0x2500, 0x2600), (0x2600, 0x27C0), (0x3000, 0x3100)]
# The characters that garbled text is likeliest to hold; the sequences of all others are matched by byte classes.
EMOJI_LEAD = (0xF0, 0x9F)
# Letter frequencies of Russian, in per mille.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", [110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 17, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.4, 0.4]))
# Frequent letter pairs of Russian.
RUSSIAN_PAIRS = "ст но то на ен ов ни ра во ко по ро ре ос ер ли не ал пр ор ла ан ет ть от го ся ел ол ат та ри ны де те се ит че ит ил ло ме за до об из ый ая ем ам ом ми ки да ту ма ис ес ка ак ва ив ве ди ед од же ри ус ск ди".split()
# Encodings of Western and Central Europe, as true ones; the wrong ones are WRONG.
EUROPEAN = ["cp1252", "cp1250", "latin-1", "iso8859-2", "cp850", "cp437", "cp852", "mac_roman", "mac_latin2"]
# Frequent words of European languages, which also show what stands beside each letter.
WORDS = {
    "de": "für über können könnte müssen müssten möglich natürlich größe größer groß großen straße schließen schließt außer außerdem heißt weiß muß daß während wäre hätte häufig nächste nächsten später prüfen geprüft überprüfen führen ausführen ausgeführt geführt schlüssel zurück rückgabe lösung lösen löschen gelöscht ändern geändert änderung änderungen länge länger enthält erhält fällt läuft lädt lässt gewählt zählen zähler einträge gründe verfügbar gültig ungültig gehört gehören hören öffnen öffnet öffentlich höher höchstens mindestgröße würde würden wünschen stück glück kürzer fünf zwölf tür grün schön böse körper wörter mögen bücher männer städte länder wärme stärke ähnlich unterstützt benötigt bestätigt ausgewählt übergeben überschreiben übernimmt erläuterung ergänzen verändert gefährlich abhängig hängen unabhängig vollständig ständig zusätzlich grundsätzlich anschließend abschließen fließen maß spaß fuß",
    "fr": "été être même après très déjà création créé créer général générer générés numéro première deuxième dernière où à là voilà ça français façon garçon reçu leçon fenêtre tête fête forêt arrête arrêter prêt intérêt côté bientôt plutôt hôtel contrôle rôle dépôt île connaître paraît naître maître goût août sûr coût où dû élément éléments état étape étapes étaient était écrit écrire école équipe évite éviter événement détail détails début dépend dépendance définir défini définie désactiver déplacer développement différent difficulté données résultat réponse répertoire réseau référence répété récupérer précédent présent prénom problème système modèle méthode paramètre paramètres caractère caractères clé clés entrée entrées vérifier vérifié utilisé utilisée supprimé ajouté appelé passé démarrage possède règle lumière manière matière dès accès succès progrès père mère frère siècle chèvre noël naïf maïs cœur sœur œuvre",
    "es": "más está están también después según así aquí allí día días función funciones versión opción configuración información aplicación dirección sección conexión acción creación código número números método métodos válido válida inválido índice último última único única página páginas línea líneas módulo módulos símbolo símbolos parámetro parámetros público públicos básico automático automáticamente rápido dinámico fácil difícil árbol tamaño año años mañana español señal pequeño pequeños niño niños añadir añade contraseña compañía vacío vacía todavía había tenía podría sería tú él sí qué cómo cuándo dónde quién será podrá deberá eliminará área través común ningún algún",
    "pt": "não são então padrão versão função funções opção opções ação ações informação configuração aplicação instalação exceção seção relação relações migração conexão botão mão irmão você vocês também até está estão já só após através código número números método módulo módulos índice último única único página páginas parâmetro parâmetros usuário usuários diretório próprio próxima possível disponível variável inválido válido é três mês ciência frequência sequência experiência existência avô pôr começo começar serviço serviços preço espaço força atenção lição edição coração razão às país saída conteúdo início família história difícil fácil política público automático",
    "pl": "się są być może można więc który która które którego również także jeśli jeżeli każdy każdego żeby że już też nie być był była było były będzie będą tylko źródło źródła ścieżka ścieżki ścieżkę błąd błędy błędu wartość wartości długość ilość część części możliwość zależności węzeł węzła właściciel właściciela własny właściwy główny głównie później pózniej między przestarzałą następna następny następnie usunięty usunąć dołączyć połączenie połączenia wyłączyć włączony łącze kraków łódź mały małe duże dużo książka język języka tysiąc miesiąc początek końca koniec dzień tydzień słowo słowa hasło plików użytkownik użytkownika użycie użyć służy zmień zmień zmienną funkcję funkcją informację proszę dziękuję święto świat światło środek środowisko śledzenie sześć pięć dziesięć mąż ręka głowa człowiek stał został została została można pojawić zwróć zwraca wyjątek krawędzi moduł żaden żadnych źle",
    "cs": "být který která které není může můžete můžeme není již také další další při před příklad příkaz příkazy připojení přidat přístup případ případě soubor souborů souboru složka hodnota že žádný žádné zpět zpráva správa správně chyba chybě úplně úvod účet čas část částí číslo čísla člověk řádek řádku řetězec uživatel uživatele uživatelé jméno název názvy počet začátek výstup vstupní výsledek výchozí hlavní první poslední nový nová nové změna změny změnit použít použití spuštění zařízení nastavení větší menší důležité důvod dům můj svůj tři čtyři pět šest město země měsíc týden příště ještě zvlášť běží děkuji kůň žlutý",
    "hu": "és ez egy már még több között után előtt első idő jövő erő felhasználó felhasználói könyvtár könyv fájl fájlok hiba üzenet üzenetek érték értéke számára szám szöveg név között működik működés művelet törlés törölni létrehozás beállítás beállítások új újra út kívül szükséges függvény függő következő kötelező lehetőség elérhető ellenőrzés megjelenítés külső belső tömb sör gyűjtemény",
    "sv": "är för från när där här så även också måste åter både på får går år många människor ändra ändring lägg lägga tillägg öppna största större före över överföring användare användning väg värde värden språk fråga frågor två från stöd språket på også når både får går år må måde første større største før hvornår køre kører kørsel højre øverst ændre ændring ændringer læse læser være værdi værdier både både fejlsøge tilføj tilføje bruges således",
}
QUOTES, SIGNS = frozenset("’‘“”…–—»«‚„´`"), frozenset("№·°±§€")
#: Lead characters that hardly occur in correct text before another non-ASCII character.
SURE_LEADS = frozenset("ÃÂâ")

_RU_LETTERS = frozenset("абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
_RUN = re.compile(r"[^\x00-\x7f]+")
# Frequent words that end or begin with a lost letter and have no other, as patterns of what is left of them.
# Behind a gap at the end the sentence has to go on, since `?` may else be its mark.
LOST_ENDS = ["si", "ju", "nast", "jeste", "prawd", "est", "aqu", "activ", "supprim", "ajout", "termin", "utilis", "appel", "voil", "dej", "perch", "citt", "funzionalit", "qualit", "propriet"]
LOST_BEGINS = ["ber\\w*", "ffn\\w+", "ffentlich\\w*", "nder(?:n|t|ung|ungen)", "hnlich\\w*", "quivalent\\w*", "cie[zż]\\w+", "rod\\w+", "wiat\\w*", "[aą]da\\w*", "adn\\w+", "aden", "aduje", "adowa\\w+", "eby", "tre", "tat", "tats", "tape\\w*", "crire", "crit\\w*", "vit(?:e|er|ez)", "quipe\\w*", "chec\\w*", "ltim[oa]s?", "ndices?", "nic[oa]s?", "rbol(?:es)?", "rea", "reas"]
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_BEFORE, _BEHIND = "(?:(?<=\\s)|(?<=^)|(?<=[(#*\"'“„«]))", "(?=[\\s,.;:)\"'”»]|$)"
#: Words with gaps between letters, and perhaps first or last too; then words with one gap, at an edge; then a letter in two halves.
_LOST = re.compile(
    rf"{_BEFORE}(\?{{0,2}}{_LETTER}+(?:\?{{1,2}}{_LETTER}+)+\?{{0,2}}){_BEHIND}"
    rf"|{_BEFORE}\?{{1,2}}(?i:{'|'.join(LOST_BEGINS)}){_BEHIND}"
    rf"|{_BEFORE}(?i:{'|'.join(LOST_ENDS)})\?{{1,2}}(?=[,;:)]| [a-zà-öø-ɏ])"
    r"|(?<= )Ã(?= )",
    re.M,
)
_GAPS = re.compile(r"\?{1,2}")
_MAYBE_LOST = re.compile(rf"\?{_LETTER}|{_LETTER}\?{{1,2}}(?:[,;:)]| [a-zà-öø-ɏ])")
#: The same for the JVM: ASCII texts without it have lost no letter.
_SUSPICIOUS = rf"[A-Za-z]\?{{1,2}}[A-Za-z]|(?i)\?(?:{'|'.join(LOST_BEGINS)})(?!\w)|\b(?:{'|'.join(LOST_ENDS)})\?{{1,2}}[ ,;:)]"
RESTORED = "doc_id bigint, restored string, garbled_spans int, lost_chars int, encodings string"


def _decode_table(encoding: str) -> list[tuple[str, ...]]:
    """For each byte what it may look like when read as ``encoding``: undefined bytes become a control
    character or U+FFFD."""
    out = []
    for b in range(256):
        try:
            out.append((bytes([b]).decode(encoding),))
        except UnicodeDecodeError:
            out.append((chr(b), "�"))
    return out


@lru_cache(1)
def _encoders() -> dict[str, dict[str, int]]:
    """encoding -> character -> byte; U+FFFD isn't in it, since its byte is lost."""
    out = {}
    for e in {*WRONG, *SINGLE_WRONG}:
        out[e] = {c: b for b, forms in enumerate(_decode_table(e)) for c in forms if c != "�"}
    return out


@lru_cache(1)
def automaton():
    """(automaton, values): a hit's value is (length, weak, encodings, pairs)."""
    import ahocorasick

    found: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))

    def spell(data: bytes, table) -> list[str]:
        forms = [""]
        for b in data:
            forms = [f + x for f in forms for x in table[b]]
        return forms

    characters = {chr(c) for lo, hi in BLOCKS for c in range(lo, hi)}
    characters |= {c for e in WRONG for forms in _decode_table(e)[128:] for c in forms}
    for e in WRONG:
        table = _decode_table(e)
        for c in characters:
            for g in spell(c.encode(), table):
                if not any(ord(x) < 128 for x in g):
                    found[g][0].add(e)
        for third in range(0x80, 0xC0):
            for fourth in range(0x80, 0xC0):
                for g in spell(bytes([*EMOJI_LEAD, third, fourth]), table):
                    if not any(ord(x) < 128 for x in g):
                        found[g][0].add(e)
    tables = {e: _decode_table(e) for e in SINGLE_WRONG}
    for true in SINGLE:
        for wrong in SINGLE_WRONG:
            if true == wrong:
                continue
            # the beginnings of words in sentence case, where a Cyrillic encoding turns case around
            openings = [a.upper() + b for a in RUSSIAN for b in RUSSIAN] if wrong in SINGLE else []
            for pair in [*RUSSIAN_PAIRS, "├──", "└──", *openings]:
                try:
                    data = pair.encode(true)
                except UnicodeEncodeError:
                    continue
                for g in spell(data, tables[wrong]):
                    if pair[0].isupper() and not (set(g) <= _RU_LETTERS and g[0].islower() and g[1].isupper()):
                        continue
                    if g != pair and not any(ord(x) < 128 for x in g) and not (set(g) <= _RU_LETTERS and g.islower()) and g not in _PLAIN_PAIRS:
                        found[g][1].add((true, wrong))
    a = ahocorasick.Automaton()
    for g, (encodings, pairs) in found.items():
        doubtful = QUOTES | SIGNS if g[0] in _RU_LETTERS else QUOTES
        weak = (len(g) == 2 and g[0].isalpha() and g[0] not in SURE_LEADS and g[1] in doubtful) or set(g) <= _RU_LETTERS or g in _PLAIN_PAIRS
        a.add_word(g, (len(g), weak, frozenset(encodings), frozenset(pairs)))
    a.make_automaton()
    return a


# Neighbours in correct text that would also be the garbled form of something.
_PLAIN_PAIRS = frozenset("éé öß çã çõ łą óź ÇÃ ÇÕ ── └─ ├─ ÖÄ ßü üß ää".split())


_CHAIN = re.compile(r"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
# What may stand before and behind a word of correct text, and behind a multiplication sign.
_AROUND = "".join(QUOTES | SIGNS) + "\xa0•¿¡"
_CAMEL = re.compile("[а-яё]+[А-ЯЁ][а-яё]*")
_TIMES = re.compile("×[½¼¾²³¹°±µ–—…“”’]")


@lru_cache(1)
def _classes() -> tuple[re.Pattern, dict[str, dict[int, str]]]:
    """A pattern of what may begin a sequence in any encoding, and for each encoding character -> byte (as a character)."""
    tables, leads, tails = {}, set(), set()
    for e in WRONG:
        encoder = _encoders()[e]
        tables[e] = defaultdict(lambda: "\0", {ord(c): chr(b) for c, b in encoder.items()})
        leads |= {c for c, b in encoder.items() if 0xC2 <= b < 0xF5}
        tails |= {c for c, b in encoder.items() if 0x80 <= b < 0xC0}
    return re.compile(f"[{re.escape(''.join(sorted(leads)))}][{re.escape(''.join(sorted(tails)))}]"), tables


def _plausible(chain: str) -> bool:
    """Whether correct text may hold ``chain``: a word in one case or capitalized with
    punctuation around it, lines of a box, or two Russian words joined in camel case."""
    word = chain.strip(_AROUND)
    if not word or all("\u2500" <= c < "\u25a0" for c in chain) or _TIMES.fullmatch(chain):
        return True
    if not word.isalpha():
        return False
    return word.islower() or word.isupper() or (word[0].isupper() and word[1:].islower()) or bool(_CAMEL.fullmatch(word))


#: Runs recur as words do.
_plausible_run = lru_cache(200_000)(_plausible)


def _find_chains(run: str, behind_small: bool = False, beside: bool = False) -> tuple[tuple[int, int, bool, frozenset[str]], ...]:
    """(start, end, sure, encodings) of the chains of sequences in ``run`` that spell assigned characters, at
    least one of which the automaton doesn't have.  A chain is sure if it isn't plausible as correct text and the
    encoding leaves next to nothing of the run over; capitals behind a small letter (``behind_small``) aren't plausible, and
    one letter alone isn't restored ``beside`` letters of ASCII."""
    begins, tables = _classes()
    if not begins.search(run):
        return ()
    found: dict[tuple[int, int, bool], set[str]] = defaultdict(set)
    for e in WRONG:
        as_bytes = run.translate(tables[e])
        chains: list[list] = []  # start, end, sequences, a character that isn't listed, a BOM
        for m in _CHAIN.finditer(as_bytes):
            at, broken = m.start(), True
            while at < m.end():
                b = as_bytes[at]
                width = 2 if b < "\xe0" else 3 if b < "\xf0" else 4
                try:
                    c = as_bytes[at : at + width].encode("latin-1").decode()
                except UnicodeDecodeError:
                    c = ""
                if c and unicodedata.category(c) not in ("Cn", "Co"):
                    if broken:
                        chains.append([at, at, 0, False, False])
                    chain = chains[-1]
                    chain[1], chain[2] = at + width, chain[2] + 1
                    chain[3] |= not any(lo <= ord(c) < hi for lo, hi in BLOCKS) and not 0x1F000 <= ord(c) < 0x20000
                    chain[4] |= c == "\ufeff"
                broken = not c or unicodedata.category(c) in ("Cn", "Co")
                at += width
        if not any(chain[3] for chain in chains):
            continue
        covered, sequences = sum(c[1] - c[0] for c in chains), sum(c[2] for c in chains)
        rest = sum(b != "\0" and c not in _AROUND for b, c in zip(as_bytes, run)) - sum(c not in _AROUND for start, end, *_ in chains for c in run[start:end])
        whole = rest == 0 or (sequences >= 4 and rest * 4 <= covered)
        for start, end, _, rare, bom in chains:
            if rare:
                piece = run[start:end]
                if beside and sequences == 1 and unicodedata.category(as_bytes[start:end].encode("latin-1").decode())[0] not in "MC":
                    continue
                odd = not _plausible(piece) or (behind_small and start == 0 and piece.isupper())
                if bom or whole and odd or not set(piece) <= _RU_LETTERS:
                    found[start, end, bom or (whole and odd)].add(e)
    return tuple((*k, frozenset(v)) for k, v in sorted(found.items()))


#: Runs recur as words do; long ones don't, and aren't remembered.
_chains_of_word = lru_cache(100_000)(_find_chains)


def _chains(text: str) -> Iterator[tuple[int, int, bool, frozenset[str]]]:
    """The hits of characters that the automaton doesn't list, as ``_find_chains``."""
    for m in _RUNS.finditer(text):
        run, at = m[0], m.start()
        before, behind = text[at - 1 : at] if at else "", text[m.end() : m.end() + 1]
        small, beside = "a" <= before <= "z", before.isalpha() or behind.isalpha()
        for start, end, sure, encodings in (_chains_of_word if len(run) <= 64 else _find_chains)(run, small, beside):
            yield at + start, at + end, sure, encodings


def _likelihood(text: str) -> tuple[float, int]:
    """Mean log frequency of the letters of ``text`` as Russian, and how many letters it has.

    A word that goes from a small letter to a capital counts as unlikely."""
    total, n = 0.0, 0
    for c in text:
        if ord(c) < 128:
            continue
        if c.isalpha() or c in "\xa0\xad" or not c.isspace():
            total += math.log(RUSSIAN.get(c.lower(), 0.1))
            n += 1
    return (total / n if n else 0.0), n


def _restore_utf8(text: str) -> tuple[str, int, set[str]]:
    """One round of restoring UTF-8 read as a single-byte encoding: text, spans, encodings."""
    hits = []
    strong: set[str] = set()
    for end, (length, weak, encodings, _) in automaton().iter(text):
        if encodings:
            start = end - length + 1
            nxt = text[end + 1 : end + 2]
            sure = not weak or (nxt.islower() and nxt.isascii())
            hits.append((start, end + 1, sure, encodings))
            if sure:
                strong |= encodings
    for hit in _chains(text):
        hits += [hit] * ((hit[1] - hit[0]) // 2)
        if hit[2]:
            strong |= hit[3]
    if not strong:
        return text, 0, set()
    # neighbouring hits join to spans; a weak hit alone counts only beside sure ones of its encoding
    hits.sort()
    spans: list[list] = []
    for start, end, sure, encodings in hits:
        if not sure and not (encodings & strong):
            continue
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
            spans[-1][2].append(encodings)
        else:
            spans.append([start, end, [encodings]])
    tally: dict[str, int] = defaultdict(int)
    for _, _, each in spans:
        for encodings in each:
            for e in encodings:
                tally[e] += 1
    order = sorted(tally, key=lambda e: (-tally[e], WRONG.index(e)))
    out, at, used = [], 0, set()
    n = k = 0
    for m in _RUN.finditer(text):
        lo, hi = m.span()
        inside = []
        while k < len(spans) and spans[k][0] < hi:
            inside.append(spans[k])
            k += 1
        if not inside:
            continue
        covered = sum(end - start for start, end, _ in inside)
        rest = sum(1 for i in range(lo, hi) if "\xc0" <= text[i] <= "\xff") - sum(1 for start, end, _ in inside for i in range(start, end) if "\xc0" <= text[i] <= "\xff")
        if rest >= 3 and rest > covered:
            continue  # letters of another kind of garbling, of which two happen to look like this kind
        fixed, e = _decoded(m[0], order)
        if fixed is not None:
            out += [text[at:lo], fixed]
            at = hi
            n += 1
            used.add(e)
            continue
        for start, end, _ in inside:
            fixed, e = _decoded(text[start:end], order)
            if fixed is None:
                fixed, some = _piecewise(text[start:end], order)
                used |= some
            else:
                used.add(e)
            out += [text[at:start], fixed]
            at = end
            n += 1
    if not n:
        return text, 0, set()
    out.append(text[at:])
    return "".join(out), n, used or strong


def _decoded(piece: str, order: list[str]) -> tuple[str | None, str]:
    """``piece`` encoded back with the first encoding whose bytes are UTF-8; None if there is none."""
    encoders = _encoders()
    for e in order:
        try:
            return bytes(map(encoders[e].__getitem__, piece)).decode("utf-8"), e
        except (KeyError, UnicodeDecodeError):
            continue
    return None, ""


def _piecewise(piece: str, order: list[str]) -> tuple[str, set[str]]:
    """Restore a span sequence by sequence: what can't be restored stays as it is."""
    out, i, used = [], 0, set()
    encoders = _encoders()
    while i < len(piece):
        for length in (4, 3, 2):
            part = piece[i : i + length]
            if len(part) < length:
                continue
            for e in order:
                try:
                    fixed = bytes([encoders[e][c] for c in part]).decode("utf-8")
                except (KeyError, UnicodeDecodeError):
                    continue
                if len(fixed) == 1:
                    out.append(fixed)
                    used.add(e)
                    i += length
                    break
            else:
                continue
            break
        else:
            out.append(piece[i])
            i += 1
    return "".join(out), used


#: A word that goes from a small letter to capitals: case turned around.
_TURNED = re.compile(r"[а-яё][А-ЯЁ]{2}")
_PAIR_SET = frozenset(RUSSIAN_PAIRS)


def _pairs(text: str) -> int:
    """How many neighbours in ``text`` are frequent letter pairs of Russian."""
    low = text.lower()
    return sum(a + b in _PAIR_SET for a, b in zip(low, low[1:]))


#: How much likelier, in nats a letter, the restored letters have to be, and how many there must be.
MARGIN, LETTERS = 0.7, 4


def _utf8_share(line: str) -> float:
    """Of the non-ASCII runs of ``line`` that sequences of the first family touch, the share they cover; 1 if one
    of the sequences can hardly be anything else.  Sequences that the automaton doesn't have count as their share
    of all characters beyond ASCII."""
    covered: set[int] = set()
    for end, (length, weak, encodings, _) in automaton().iter(line):
        if encodings:
            if not weak and line[end - length + 1] in SURE_LEADS:
                return 1.0
            covered.update(range(end - length + 1, end + 1))
    long = sum(end - start for start, end in {hit[:2] for hit in _chains(line) if hit[2]})
    touched = sum(m.end() - m.start() for m in _RUN.finditer(line) if not covered.isdisjoint(range(*m.span())))
    return max(len(covered) / (touched or 1), long and long / sum(not c.isascii() for c in line))


def _restore_single(text: str, guarded: bool = False) -> tuple[str, int, set[str]]:
    """Restore lines of a Cyrillic encoding read as another single-byte encoding: text, spans, pairs.

    ``guarded`` leaves lines alone that the first family covers for the most part."""
    lines: dict[tuple[int, int], dict] = {}
    for end, (length, _, _, pairs) in automaton().iter(text):
        if pairs:
            start = text.rfind("\n", 0, end) + 1
            stop = text.find("\n", end)
            tally = lines.setdefault((start, stop if stop >= 0 else len(text)), defaultdict(int))
            for p in pairs:
                tally[p] += 3 if text[end - 1].islower() and text[end].isupper() else length - 1
    if not lines:
        return text, 0, set()
    out, at, n, used = [], 0, 0, set()
    encoders = _encoders()
    for (start, stop), tally in sorted(lines.items()):
        line = text[start:stop]
        if guarded and _utf8_share(line) > 0.6:
            continue
        now, letters = _likelihood(line)
        best = None
        most = max(tally.values())
        for (true, wrong), hits in tally.items():
            if hits < max(2, most // 2):
                continue
            table = encoders[wrong]
            pieces, good, spans = [], True, 0

            def swap(m: re.Match) -> str:
                nonlocal spans
                run = m[0]
                if all(c in _RU_LETTERS for c in run) and run.islower():
                    return run  # correct text beside garbled text
                try:
                    fixed = bytes([table[c] for c in run]).decode(true)
                except (KeyError, UnicodeDecodeError):
                    return run
                spans += 1
                return fixed

            candidate = _RUN.sub(swap, line)
            value, count = _likelihood("".join(b for a, b in zip(line, candidate) if a != b))
            before, _ = _likelihood("".join(a for a, b in zip(line, candidate) if a != b))
            # between two Cyrillic encodings letters stay letters: there the pairs decide
            paired, were = _pairs(candidate), _pairs(line)
            turned = _TURNED.search(line) and not _TURNED.search(candidate)
            likelier = value - before >= MARGIN or (turned and paired > were) or (value - before >= 0.15 and paired >= 2 and paired >= 3 * were)
            boxes = any(x in candidate and x not in line for x in ("├──", "└──"))
            shared = sum(c in _RU_LETTERS for c in candidate)
            if (count >= LETTERS and likelier and shared >= count // 2) or (boxes and not shared):
                score = (value - before if not boxes else 10.0) + candidate.count(" ") * 0
                upper = sum(1 for a, b in zip(candidate, candidate[1:]) if a.islower() and b.isupper())
                score -= 0.3 * upper
                if best is None or score > best[0]:
                    best = (score, candidate, spans, f"{true}>{wrong}")
        if best:
            out += [text[at:start], best[1]]
            at = stop
            n += best[2]
            used.add(best[3])
    out.append(text[at:])
    return "".join(out), n, used


_TOKEN = re.compile(r"(?<![A-Za-z\x80-\uffff])[A-Za-z]*[\x80-\uffff][A-Za-z\x80-\uffff]*")
#: What may stand between two letters in correct text though it is no letter.
_JOINTS = frozenset("’‘´`'\xa0\xad-–—…·•×→←│«»“") | {chr(c) for c in range(0x2500, 0x25A0)}


_MARKS_1252 = frozenset("‚„…†‡ˆ‰‹‘’“”•–—˜™›€")


@lru_cache(1)
def _languages() -> tuple[dict[str, frozenset[str]], dict[str, frozenset[str]], frozenset[str]]:
    """Of each language the letters beyond ASCII and the letter pairs with them (a blank is a word's edge); all words."""
    letters, pairs, words = {}, {}, set()
    for language, text in WORDS.items():
        each = text.split()
        words.update(each)
        letters[language] = frozenset(c for c in "".join(each) if not c.isascii())
        pairs[language] = frozenset(a + b for w in each for a, b in zip(f" {w}", f"{w} ") if not (a + b).isascii())
    return letters, pairs, frozenset(words)


def _cased(word: str) -> bool:
    return word.islower() or word.isupper() or (word[0].isupper() and word[1:].islower())


def _odd(token: str) -> bool:
    """Whether correct text can't hold ``token``: between its letters are signs, controls, capitals behind small
    letters or letters of another script."""
    latin = [c.isascii() or "\xc0" <= c < "\u0250" and c not in "×÷" for c in token]
    for i in range(1, len(token) - 1):
        c = token[i]
        if c.isascii() or c in _JOINTS or not (token[i - 1].isascii() or token[i + 1].isascii()) and not any(x.isascii() for x in token):
            continue
        if not latin[i] and any(latin[:i]) and any(latin[i + 1 :]) or (c.isupper() and token[i - 1].islower() and token[i + 1].islower()):
            return True
    return any("\x80" <= c < "\xa0" for c in token)


def _fits(word: str, language: str) -> int:
    """2 if all letters beyond ASCII stand beside letters that they are known beside, else 0."""
    pairs = _languages()[1][language]
    word = f" {word.lower()} "
    return 2 * all(a + b in pairs for a, b in zip(word, word[1:]) if not (a + b).isascii())


@lru_cache(100_000)
def _readings(token: str) -> tuple[tuple[tuple[str, str], str, int], ...]:
    """((true, wrong), word, evidence) of the ways to read ``token`` as a word of a European language."""
    letters, _, words = _languages()
    bare = token.strip(_AROUND)
    odd = _odd(token)
    if bare.lower() in words:
        return ()
    alone = not any("a" <= c.lower() <= "z" for c in token)
    controls = {c for c in token if "\x80" <= c < "\xa0"} - {"\x85"}
    known = not odd and _cased(bare) and any(set(x for x in bare.lower() if not x.isascii()) <= letters[g] and _fits(bare, g) for g in letters) if bare else False
    out = []
    encoders = _encoders()
    for wrong in WRONG:
        try:
            data = bytes(ord(c) if c.isascii() else encoders[wrong][c] for c in token)
        except KeyError:
            continue
        for true in EUROPEAN:
            try:
                word = data.decode(true)
            except UnicodeDecodeError:
                continue
            low = word.lower()
            if controls and true in ("cp1252", "cp1250") and not alone and not word.isalpha():
                bared = "".join(c for c in low if c not in _MARKS_1252)
                if (bared.isascii() or any({c for c in bared if not c.isascii()} <= letters[g] for g in letters)) and (not bared or bared.isalpha()):
                    out.append(((true, wrong), word, 2))
                continue
            if true == wrong or word == token or not word.replace("’", "", 1).isalpha() or not _cased(word) or (alone and low not in words):
                continue
            beyond = {c for c in low if not c.isascii()} - {"’"}
            if not beyond and odd:  # an elision alone is no evidence
                out.append(((true, wrong), word, 0))
            fitting = [g for g in letters if beyond <= letters[g]]
            if not beyond or not fitting:
                continue
            if alone:
                value = 0
            elif low in words and len(low) > 2:
                value = 4
            elif odd:
                low = low.rpartition("’")[2]
                value = 2 if len(word) >= 4 and any(_fits(low, g) for g in fitting) else 0
            elif known:
                continue
            else:
                value = 0
            out.append(((true, wrong), word, value))
    return tuple(out)


def _restore_european(text: str) -> tuple[str, int, set[str]]:
    """Restore words of a European single-byte encoding read as another: text, spans, pairs.

    A document has evidence of a pair in words that can't be correct and become likely ones, and in frequent words
    that come out; then all words that the pair turns from unlikely into possible ones are restored."""
    spans, used = 0, set()
    while True:  # a pair is taken once, so it ends
        tally: dict[tuple[str, str], int] = defaultdict(int)
        for token in _TOKEN.findall(text):
            if len(token) <= 40:
                for pair, _, value in _readings(token):
                    tally[pair] += value
        best = max(tally, key=lambda p: (tally[p], -EUROPEAN.index(p[0]), -WRONG.index(p[1])), default=None)
        if best is None or tally[best] < 2 or f"{best[0]}>{best[1]}" in used:
            break

        def swap(m: re.Match) -> str:
            nonlocal spans
            if len(m[0]) <= 40:
                for pair, word, value in _readings(m[0]):
                    if pair == best and (value or _odd(m[0]) or m[0].strip(_AROUND) == m[0]):
                        spans += 1
                        return word
            return m[0]

        text = _TOKEN.sub(swap, text)
        used.add(f"{best[0]}>{best[1]}")
    return text, spans, used


def _lost(text: str) -> int:
    """How many gaps of lost letters ``text`` shows.

    A word with gaps between its letters is in small letters, capitalized, or (from four letters on) in capitals.
    Words with a gap only at an edge, where `?` may be a mark, count if they are known ones."""
    n = 0
    for m in _LOST.finditer(text):
        word = m[1]
        if word is None:
            n += 1
            continue
        gaps = len(_GAPS.findall(word))
        letters = word.replace("?", "")
        if letters.islower() or (len(letters) >= 4 and (letters.isupper() or (letters[0].isupper() and letters[1:].islower()))):
            n += gaps
    return n


def restore(text: str) -> tuple[str, int, int, list[str]]:
    """(restored text, garbled spans replaced or seen, characters lost, encodings).

    Correct text comes back unchanged with 0 spans and 0 lost characters.  Empty text is correct.
    """
    # the full pattern runs only where its rarest part occurs
    lost = _lost(text) if _MAYBE_LOST.search(text) or " Ã " in text else 0
    if text.isascii():
        return text, 0, lost, []
    lost += text.count("�")
    text, others, scripts_used = scripts.restore_lines(text, _encoders(), WRONG[:-1], _plausible_run)
    runs = " ".join(_RUNS.findall(text))  # a garbled sequence lies within a run
    if not runs or next(automaton().iter(runs), None) is None and not any(hit[2] for hit in _chains(text)):
        fixed, n, used = _restore_european(text)
        return fixed, n + others, lost, sorted(used | scripts_used)
    text, spans, encodings = _restore_single(text, True)
    spans, encodings = spans + others, encodings | scripts_used
    while True:  # each round makes the text shorter, so it ends however often the text was garbled
        before = text
        text, n, used = _restore_utf8(text)
        spans += n
        encodings |= used
        if len(text) >= len(before):
            break
    for rule in (_restore_single, _restore_european):
        text, n, used = rule(text)
        spans += n
        encodings |= used
    return text, spans, lost, sorted(encodings)


def _restore_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            rows = [(d, *restore(t)) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            rows = [r for r in rows if r[2] or r[3]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array([",".join(r[4]) for r in rows], pa.string())],
                names=["doc_id", "restored", "garbled_spans", "lost_chars", "encodings"],
            )


def garbled_documents(documents: DataFrame) -> DataFrame:
    """doc_id, restored, garbled_spans, lost_chars, encodings of the documents that show wrong decoding.

    Texts that are pure ASCII without a ``?`` inside a word can't be affected and stay in the JVM.  Null
    and empty texts are never affected.  Repeated rows give repeated results.
    """
    suspicious = (F.length("text") != F.octet_length("text")) | F.col("text").rlike(_SUSPICIOUS)
    return spread(documents.where(suspicious).select("doc_id", "text"), "doc_id").mapInArrow(_restore_batches, RESTORED)
