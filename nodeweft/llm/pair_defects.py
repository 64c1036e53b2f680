"""Problem 3: broken prompt and response pairs.

Ordered rules look at the answer and at the question it is stored with:

1. empty: nothing but invisible characters, punctuation, markup or a stand-in for "nothing";
2. copy: the question again from its first word on, perhaps under a label, cut short or repeated;
3. refusal: at least one sentence in which the speaker declines (a third person who can't do something is a fact), and every
   other one is an apology, a courtesy or a hint to ask elsewhere;
4. truncated: an unclosed code block, code span, bracket or quotation, or an end amid a sentence;
5. language: prose of another script than the question's, or with clearly more function words of another language, unless
   the question asks for that language. Without such words a text isn't judged.

`defects` returns every rule that a pair triggers, in this order; `first_defect` the first of them.

Defined results: an answer stored as JSON is judged by its `content`; a question without words (blank, invisible, or the
mark of a picture) gives way to the context question; a pair without any words in both is never copy or language; texts of
any length are read whole; equal rows give one result.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

RULES = ("empty", "copy", "refusal", "truncated", "language")

#: Texts that stand for "nothing".
NOTHING = set("none null nil nan undefined empty n/a na nothing blank void missing tbd todo unknown unanswered".split()) | set(
    "no answer|no response|no reply|no content|no data|no text|no output|no result|not available|not applicable|not answered|no answer given|no answer available|empty answer|empty response|empty string|answer missing|"
    "rien|vide|aucune réponse|pas de réponse|sans réponse|nada|vacío|ninguno|ninguna|sin respuesta|leer|nichts|keine|keine antwort|ohne antwort|vazio|nenhum|nenhuma|sem resposta|vuoto|niente|nessuno|nessuna|nessuna risposta".split("|")
)

_LONGEST_NOTHING = max(map(len, NOTHING))

#: What may be written before a repeated question.
LABELS = set(
    "q a question questions answer answers response reply prompt user assistant asked you the query original input output your was is "
    "frage antwort pregunta respuesta réponse reponse pergunta resposta domanda risposta ai bot human me to re".split()
)

#: What may stand between "I" and what it declines; a word that opens a clause about something else ends it.
_GAP = r"(?:\W+(?!(?:that|which|who|if|see|saw|found|find|think|believe|know|checked|read|say|the|an?|it|they|he|she|you|these|those|its)\b)[\w'’]+){0,4}?\W+"
_ANSWER = r"(?:help|answer|assist|discuss|share|provide|respond|reply|comment|say|tell|talk|speak|comply|reveal|disclose|give|do (?:that|this)|continue|go into)"
#: How a speaker declines, by language, with words of which one must be there. English has no verb forms that
#: show the speaker, so there it takes a subject of the first person, or a form that is only said of oneself.
_DECLINES = {
    "en": (
        ("not", "n't", "n’t", "unable", "declin", "refus", "pass", "impossib", "forbid", "prohibit", "restrict", "allowed", "against my", "because of my", "comment", "outside", "beyond", "violat", "my ", "limits", "bounds", "never", "abstain", "refrain"),
        r"\b(?:I|we|this assistant|the assistant)(?:['’](?:m|re|ve|d|ll))?" + _GAP + r"(?:can ?not|can['’]t|won['’]t|will not|would not|wouldn['’]t|could not|couldn['’]t|(?:not|never) (?:be )?(?:able|permitted|allowed|authori[sz]ed|willing|going|comfortable|prepared|free|supposed|at liberty|in a position)|unable|forbidden|prohibited|restricted|declin(?:e|ing)|refus(?:e|ing)|abstain|refrain|pass|(?:rather|prefer) not|prefer to not|(?:do not|don['’]t) (?:feel comfortable|want to|wish to|have permission|" + _ANSWER + r")|(?:told|instructed|asked|advised) not to|(?:may|must|shall|should) not)\b"
        r"|\b(?:I['’](?:m|d|ll)|we['’](?:re|d|ll)) (?:not|rather not|never|unable)\b|\b(?:not possible|impossible|off[- ]limits|out of bounds) (?:for|to) (?:me|us)\b|\bnot something (?:that )?(?:I|we)\b"
        r"|^\W*(?:(?:sorry|apologies|unfortunately|regrettably|no)\W+(?:but\W+)?)?(?:can ?not|can['’]t|won['’]t|unable to|not able to|not (?:allowed|permitted|going|willing) to|(?:must|will|would|have to) (?:decline|refuse|pass)|declin(?:e|ing) to|refus(?:e|ing) to|(?:would )?(?:prefer|rather) not(?: to)?) ?" + _ANSWER + r"?\b(?<!cannot)(?<!can not)(?<!can['’]t)(?<!won['’]t)"
        r"|\bagainst my (?:\w+ )?(?:guidelines?|polic(?:y|ies)|rules|instructions|principles)|\bbecause of my polic|\bno comment\b|\boutside (?:of )?(?:what (?:I|we)\b|the scope of what (?:I|we)\b|my\b)|\bbeyond (?:what (?:I|we)\b|my (?:scope|remit))|\bviolat\w+ my|\bnot (?:within|in) my (?:scope|remit|power)|\bmy (?:guidelines|policy|instructions) (?:do not|don['’]t|forbid|prohibit)",
    ),
    "fr": (('je ', "m'est", 'm’est', 'pas ', 'abst', 'impossib', 'moi'), r"\bje (?:ne|n['’]) ?(?:suis pas (?:en mesure|autorisé|capable|habilité)|peux (?:pas|rien|malheureusement)|puis|veux pas|souhaite pas|dois pas|répond(?:s|rai) pas|saurais|pourrai pas)|\bje (?:préfère|préférerais|refuse|dois (?:refuser|décliner)|décline)|\bm['’]est (?:impossible|interdit)|pas (?:possible|permis) pour moi|je m['’]abstien|impossible (?:pour moi )?de (?:répondre|vous aider)|pas le droit de"),
    "es": (('no ', 'niego', 'negarme', 'prefier', 'prefer', 'declin', 'abst', 'rechaz', 'imposib'), r"\bno (?:puedo|podré|podría|debo|quiero|deseo|voy a (?:responder|contestar|hablar|ayudar)|me (?:está|es) (?:permitido|posible)|se me permite|estoy (?:autorizad|en condiciones|capacitad)|tengo (?:permiso|permitido|autorización)|me siento)|\b(?:prefiero|preferiría) no|\bme niego|(?:debo|tengo que) (?:rechazar|declinar|negarme)|declino|me abstengo|me resulta imposible"),
    "de": (('nicht', 'nichts', 'kein', 'weder', 'ablehn', 'lehne', 'verweig', 'untersagt', 'verboten'), r"\b(?:ich|mir) (?:kann|darf|möchte|will|werde|könnte|soll)\b[^.!?]*\b(?:nicht|nichts|keine?[nrms]?|weder)\b|\b(?:kann|darf|möchte|will|werde) ich\b[^.!?]*\b(?:nicht|nichts|keine?[nrms]?)\b|\bich (?:muss|möchte)\b[^.!?]*\bablehnen|\bich (?:lehne|verweigere|bin nicht (?:befugt|berechtigt|in der lage|bereit))|\bmir (?:ist|wurde) (?:es )?(?:nicht (?:erlaubt|gestattet|möglich)|untersagt|verboten)|ist (?:es )?mir (?:leider )?(?:nicht|untersagt)"),
    "pt": (('não', 'prefir', 'prefer', 'recus', 'declin'), r"\bnão (?:posso|poderei|devo|quero|vou (?:responder|ajudar|falar|comentar)|tenho (?:permissão|autorização)|estou (?:autorizad|em condições)|me (?:é|está) permitid|consigo (?:ajudar|responder)|me sinto)|\b(?:prefiro|preferiria) não|\bme recuso|recuso-me|(?:devo|tenho que|preciso) (?:recusar|declinar)"),
    "it": (('non ', 'prefer', 'rifiut', 'declin', 'impossib'), r"\bnon (?:posso|potrò|devo|voglio|desidero|sono (?:autorizzat|in grado|nella posizione)|mi è (?:permess|consentit|possibile)|ho il permesso|risponderò|me la sento)|\b(?:preferisco|preferirei) non|\bmi rifiuto|(?:devo|sono costretto a) (?:rifiutare|declinare)|mi è impossibile"),
    "nl": (("niet", "geen", "weiger", "afwijzen"), r"\b(?:ik|wij)\b[^.!?]*\b(?:niets?|geen)\b|\bik (?:weiger|moet (?:\w+ )?(?:weigeren|afwijzen))|\b(?:kan|mag|wil|zal) ik\b[^.!?]*\b(?:niets?|geen)\b"),
    "sv": (("inte", "inget", "vägrar", "avböj", "ingenting"), r"\b(?:jag|vi)\b[^.!?]*\b(?:inte|inget|ingenting)\b|\bjag (?:vägrar|avböjer|måste avböja)"),
    "da": (("ikke", "nekter", "nægter", "afslå", "avslå"), r"\b(?:jeg|vi)\b[^.!?]*\bikke\b|\bjeg (?:nekter|nægter|(?:må )?a[fv]slår?)\b"),
    "pl": (("nie ", "odmawiam", "odmówić"), r"\bnie (?:mogę|możemy|chcę|wolno mi|jestem w stanie|odpowiem|pomogę)\b|\bodmawiam\b|\bmuszę odmówić"),
    "cs": (("nemohu", "nemůžu", "nesmím", "odmít"), r"\b(?:nemohu|nemůžu|nesmím|odmítám|musím odmítnout)\b"),
    "ro": (("nu ", "refuz"), r"\bnu (?:pot|am voie|doresc)\b|\brefuz\b"),
    "tr": (("amam", "emem", "amıyor", "emiyor", "redde"), r"\b(?:yanıtlay|cevaplay|yardımcı ol|paylaş|konuş|söyley)\w*(?:amam|emem|amıyorum|emiyorum)\b|\breddediyorum\b"),
    "fi": (("en ", "kieltäyd"), r"\ben (?:voi|saa|pysty|halua)\b|\bkieltäydyn\b"),
    "hu": (("nem ", "elutasít"), r"\bnem (?:tudok|válaszolhatok|segíthetek|tehetem|szabad)\b|\belutasítom\b"),
    "ru": (("не ", "нельзя", "отказ", "запрещ"), r"\b(?:я|мы) не (?:могу|можем|буду|хочу|имею права)|\bне (?:могу|можем) (?:ответить|отвечать|помочь|обсуждать|рассказать)|\bотказываюсь\b|\bвынужден\w* отказать|\bмне (?:нельзя|не разрешено|запрещено)"),
    "zh": (("不能", "无法", "不可以", "不便", "拒绝", "無法"), r"我(?:們|们)?(?:不能|无法|無法|不可以|不便|拒绝)|(?:无法|無法|不能)(?:回答|提供|协助|透露)"),
    "ja": (("ません", "かねます", "断り"), r"(?:答え|回答|手伝い|対応|提供)[^。]{0,8}(?:できません|かねます)|お断り"),
}
_DECLINES = {lang: (keys, re.compile(form, re.I)) for lang, (keys, form) in _DECLINES.items()}
_KEYS = tuple(dict.fromkeys(k for keys, _ in _DECLINES.values() for k in keys))


def declines(sentence: str, low: str) -> bool:
    """Whether a sentence, `low` in lower case, declines in any of the languages."""
    return any(any(map(low.__contains__, keys)) and form.search(sentence) is not None for keys, form in _DECLINES.values())


#: What makes an "I can't" a statement about the graph and not a refusal.
_SEARCHED = re.compile(r"\b(?:could not|couldn['’]t|cannot|can['’]t|can not|unable to|not able to) (?:find|see|locate|detect|identify|spot|trace|reach|resolve|match|be (?:called|reached|deleted|opened|found|resolved|changed))\b", re.I)
_FILLER = re.compile(
    r"^\W*(?:(?:I ?['’]?a?m (?:very |so |really |truly )?)?(?:sorry|afraid)\b[^:]*|(?:my |our )?(?:sincere )?apolog(?:y|ies|i[sz]e)\b[^:]*|I apologi[sz]e\b[^:]*|unfortunately|regrettably|well|hmm+|thanks?\b[^:]*|thank you\b[^:]*|let me know\b.*|is there (?:something|anything)\b.*|(?:please|kindly) (?:ask|contact|try|consult|reach|see|refer|check|rephrase|feel free|choose|understand)\b.*|maybe (?:try|ask)\b.*|(?:try|ask|contact|consult) (?:the|your|another|a|someone)\b.*|perhaps (?:try|ask|you)\b.*|you (?:may|might|could|can) (?:want to )?(?:ask|try|contact|consult)\b.*|feel free\b.*|can I help\b.*|how else\b.*|(?:i )?hope (?:that|you|this)\b.*|as an? (?:ai|assistant|language model)\b[^:]{0,20}"
    r"|désolé\b.*|je suis (?:vraiment )?désolé\b.*|pardon\b.*|merci\b.*|lo siento\b.*|perdón\b.*|disculp\w+\b.*|gracias\b.*|(?:es )?tut mir leid\b.*|entschuldig\w+\b.*|danke\b.*|leider\b.{0,3}|het spijt (?:me|mij|ons)\b.*|helaas\b.{0,3}|tyvärr\b.{0,3}|(?:jag är )?ledsen\b.*|beklager\b.*|desværre\b.{0,3}|dessverre\b.{0,3}|przykro mi\b.*|przepraszam\b.*|niestety\b.{0,3}|omlouvám se\b.*|bohužel\b.{0,3}|îmi pare rău\b.*|üzgünüm\b.*|anteeksi\b.*|sajnálom\b.*|извините\b.*|к сожалению\b.{0,3}|(?:很|非常)?抱歉.*|对不起.*|申し訳.*|desculp\w+\b.*|obrigad\w\b.*|sinto muito\b.*|mi dispiace\b.*|scus\w+\b.*|grazie\b.*|veuillez\b.*|bitte\b.*|por favor\b.*|per favore\b.*|demandez\b.*|pregunta a\b.*|consulta\b.*|frag\w* (?:bitte )?(?:jemand|deinen|ihren)\b.*)\W*$",
    re.I,
)

#: Function words and modal verbs by language; a word that several share counts a part for each.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as are this be by from or an not which who what why how does do did can may if when where you your its was were has have had will would only there because before after than then them they their these those into over about also so no yes out up all any each other some most within between i we he she my our could should while without nothing nobody please explain list come same two one once",
    "fr": "le la les des et une dans est que pour sur avec pas qui du au aux ce cette ces son sa ses leur leurs il elle ils elles nous vous je ne ni ou où mais donc car par plus sont été être avoir ont fait peut doit cela ça si comme entre sans sous après avant pendant toujours déjà ici quelle quel quels quelles quoi comment pourquoi autres un en y se aussi deux même seul seule juste rien chaque sert à de l d n s qu c",
    "es": "el los las una que en por con para del se no es un al lo su sus como más pero le ya o este esta estos estas sí porque cuando muy sin sobre también me hasta hay donde quien quién qué cuál cuáles dónde cómo desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos unos yo otro otras otra él tanto esa puede cada mismo están de la y a son sirve dos solo",
    "de": "der die das und den von mit ist ein eine einer einem einen nicht auf im zu in dem des sich für als auch es an werden aus er hat dass sie nach wird bei um noch wie über so zum haben nur oder aber vor zur bis mehr durch man dann soll sind wer was wo wann warum wozu welche welcher welches welchen wohin woher kann darf muss ich du wir ihr ihre sein seine keine kein alle alles diese dieser dieses diesen zwei selben sonst deshalb am dient",
    "pt": "o os as um uma que em por com para do da dos das não se no na nos nas ao aos à às é são foi ser como mais mas ou já também só pelo pela pelos pelas até isso ela ele entre depois sem mesmo quando muito seu sua seus suas quem qual quais onde porque essa esse esta este estas estes há está estão têm tem nada cada durante antes pois pode de e a serve duas somente tudo isto aqui",
    "it": "il lo gli le un uno una di del della dei delle dello degli che è in con per non si da dal dalla dai dalle nel nella nei nelle al alla ai alle sono come più ma o anche se ci questo questa questi queste quello quella suo sua suoi loro chi cosa quale quali dove quando perché prima dopo senza tra fra ogni stesso solo due viene vengono può e a la i serve quindi esiste nient altro",
}
#: Function words of further languages, used where the lists above don't have them.
FURTHER_WORDS = {
    "nl": "het een van op voor zijn niet ook maar wordt worden bij naar uit deze dit heeft hebben geen nog elke tot door wel wie waar welke kan zal daar hier je ik jij hij wij zij dan toen omdat dus alleen moet onder tussen na tegen",
    "sv": "och att det som är av för på med till har inte ett jag från vid eller sedan efter när också hos sig sin så ska allt alla över utan mellan vilken vilka var här där den de men kan om",
    "da": "og at det er ikke af av på med til har som et jeg fra ved eller når også hos sig sin så skal alt alle over uden mellem hvilken hvem hvor her der den men kan hvis etter efter etter bare",
    "pl": "nie się jest że jak przez dla który która które są oraz tylko może być ale gdy tego tym przy ze od do na w z i to po jego jej ich lub co kto gdzie",
    "cs": "je že se na pro jako které který která jsou nebo ale aby jen může být při do v z i to po jeho její jejich co kdo kde než však také",
    "ro": "și este nu că pentru din care sunt cu prin doar poate fi când dar sau lui ei cine unde ce mai în pe după între fără",
    "tr": "ve bir bu için ile olarak değil daha gibi kadar sonra ama her hangi nasıl nerede kim olan çok var yok ancak veya",
    "fi": "on ei että kun mutta tai myös joka jotka ovat kuin vain sen tämä mikä missä kuka niin jos koska ilman kaikki",
    "hu": "és hogy nem az egy ez van vagy csak mint már még kell lehet amely aki hol mi ki ha de után előtt nélkül minden",
}
_KNOWN = {w for ws in FUNCTION_WORDS.values() for w in ws.split()}
_LISTS = {lang: set(ws.split()) for lang, ws in FUNCTION_WORDS.items()} | {lang: set(ws.split()) - _KNOWN for lang, ws in FURTHER_WORDS.items()}
#: For each word the languages it speaks for, by their numbers, and the weight it gives each of them.
_LANGUAGES = tuple(_LISTS)
_OF = {w: tuple(i for i, ws in enumerate(_LISTS.values()) if w in ws) for ws in _LISTS.values() for w in ws}
_SPEAKS = {w: (of, 1.0 / len(of)) for w, of in _OF.items()}
_MARKS = ".,;:!?()[]{}\"'«»“”„¿¡…*_-–—>"
#: Letters that only some of the languages use.
_LETTERS = tuple((letter, tuple(_LANGUAGES.index(lang) for lang in of.split())) for letter, of in (("ß", "de"), ("ñ", "es"), ("¿", "es"), ("¡", "es"), ("ã", "pt"), ("õ", "pt"), ("œ", "fr"), ("ê", "fr pt"), ("ç", "fr pt"), ("ä", "de"), ("ö", "de"), ("ü", "de es"), ("è", "fr it"), ("ì", "it"), ("ò", "it"), ("ù", "fr it"), ("î", "fr"), ("ô", "fr pt"), ("û", "fr")))
_NAMES = {
    "en": r"english|englisch|anglais|inglés|ingles|inglês|inglese",
    "fr": r"french|französisch|français|francais|francés|frances|francês|francese",
    "es": r"spanish|spanisch|espagnol|español|espanol|castellano|espanhol|spagnolo",
    "de": r"german|deutsch|allemand|alemán|aleman|alemão|alemao|tedesco",
    "pt": r"portuguese|portugiesisch|portugais|portugués|portugues|português|portoghese",
    "it": r"italian|italienisch|italien|italiano",
    "nl": r"dutch|niederländisch|holländisch|néerlandais|holandés|neerlandés|holandês|olandese|nederlands",
    "sv": r"swedish|schwedisch|suédois|sueco|svedese|svenska",
    "da": r"danish|norwegian|dänisch|norwegisch|danois|norvégien|danés|noruego|dinamarquês|norueguês|danese|norvegese|dansk|norsk",
    "pl": r"polish|polnisch|polonais|polaco|polonês|polacco|polsku",
    "cs": r"czech|tschechisch|tchèque|checo|tcheco|ceco|česky",
    "ro": r"romanian|rumänisch|roumain|rumano|romeno|rumeno|română",
    "tr": r"turkish|türkisch|turc|turco|türkçe",
    "fi": r"finnish|finnisch|finnois|finlandés|finlandese|suomeksi",
    "hu": r"hungarian|ungarisch|hongrois|húngaro|ungherese|magyarul",
    "ru": r"russian|russisch|russe|ruso|russo",
    "zh": r"chinese|chinesisch|chinois|chino|chinês|cinese",
    "ja": r"japanese|japanisch|japonais|japonés|japonês|giapponese",
}
_ASKED = {lang: re.compile(rf"\b(?:in|en|auf|em|into|to)\s+(?:\w+\s+)?(?:{names})\b", re.I) for lang, names in _NAMES.items()}

_FENCE = re.compile(r"^[ \t]*(?:>[ \t]*)?(`{3,}|~{3,})[^\n]*$", re.M)
_CODE = re.compile(r"(`{3,}|~{3,}).*?(?:\1|\Z)|`[^`\n]*`", re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|&(?:nbsp|ensp|emsp|thinsp|zwnj|zwj|#\d+|#x[0-9a-f]+);", re.I)
_FOREIGN = re.compile(r"[^\W\d_\x00-\u036f]")
_ITEM = re.compile(r"^\s*(?:[-*+•–]|\d{1,3}[.)]|[a-z]\))\s+\S")
_CLOSERS = "\"'”’»)]}*_`›|>"
_ENDS = ".!?…。！？؟।"
_DANGLING = re.compile(r"(?:^|[\s'’])(?:the|a|an|of|to|in|on|at|by|for|with|and|or|but|is|are|was|were|that|which|from|as|its|le|la|les|de|du|des|et|ou|un|une|dans|par|pour|el|los|las|y|en|con|por|del|der|die|das|und|von|im|zu|ein|eine|o|os|e|em|com|da|do|il|lo|di|che|per|nel)\s*$", re.I)


#: Characters that show nothing: controls, format marks, separators and fillers.
_INVISIBLE = "".join(chr(c) for c in range(0x3200) if unicodedata.category(chr(c))[0] in "CZ" and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")) + "\u2800\u3164\u115f\u1160\uffa0\ufe0f\ufeff\ufff9\ufffa\ufffb"


def visible(text: str | None) -> str:
    """A text without invisible characters at its ends; empty if it holds nothing else."""
    return text.strip(_INVISIBLE) if text else ""


def stored_answer(answer: str | None) -> tuple[str, bool]:
    """The words of an answer and whether it is JSON that breaks off."""
    text = visible(answer)
    if text.startswith("{") and re.match(r'\{\s*"(?:type|content|detail|answer)"\s*:', text):
        try:
            value = json.loads(text, strict=False)
        except ValueError:
            inner = re.search(r'"(?:content|answer)"\s*:\s*"(.*)', text, re.S)
            return (inner[1] if inner else "", True)
        if isinstance(value, dict):
            content = value.get("content", value.get("answer"))
            return (visible(content) if isinstance(content, str) else "" if content is None else json.dumps(content), False)
    return text, False


def has_words(text: str | None) -> bool:
    """Whether a question says anything; the mark of a picture doesn't."""
    return bool(re.search(r"[^\W_]", visible(text))) and not re.fullmatch(r"\W*(?:image|picture|photo|screenshot)\W*", visible(text), re.I)


def is_empty(text: str) -> bool:
    bare = _TAG.sub(" ", text) if "<" in text or "&" in text else text
    if "```" in text or "~~~" in text:
        bare = re.sub(r"^[ \t]*(?:`{3,}|~{3,})[\w+-]*[ \t]*$", " ", bare, flags=re.M)
    if not re.search(r"[^\W_]", bare):
        return True
    letters = 0
    for part in re.finditer(r"[\w/]+", bare):
        letters += len(part[0].strip("_"))
        if letters > _LONGEST_NOTHING:
            return False
    return re.sub(r"[^\w/]+", " ", bare).strip(" _").lower() in NOTHING or re.fullmatch(r"\W*n\s*[/.]\s*a\.?\W*", bare, re.I) is not None


_WORDS = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\W_]")


def plain_words(text: str) -> list[str]:
    return _WORDS.findall(unicodedata.normalize("NFKC", text).casefold())


def is_copy(text: str, question: str) -> bool:
    """Whether an answer is the question again, once or repeated, from its first word on, apart from labels: each copy keeps
    the order of the question's words, and at least three quarters of the longest are there."""
    asked = plain_words(question)
    if not asked:
        return False
    known, at, most, said = set(asked), 0, 0, 0
    for m in _WORDS.finditer(unicodedata.normalize("NFKC", text).casefold()):
        w = m[0]
        said += 1
        if at < len(asked) and w == asked[at]:
            at += 1
        elif w == asked[0] and at:
            # The question begins again.
            most, at = max(most, at), 1
        elif w not in LABELS or w in known and at not in (0, len(asked)):
            return False
    return said > 0 and max(most, at) >= 0.75 * len(asked)


_SENTENCE_END = re.compile(r"([.!?…。！？])[\"'”»)]*\s+|(?<=[。！？])|\n")


def sentences(text: str) -> Iterator[str]:
    """The sentences of a text that hold a letter or digit, one by one."""
    at = 0
    for end in itertools.chain(_SENTENCE_END.finditer(text), (None,)):
        s = (text[at : end.start()] + (end[1] or "") if end else text[at:]).strip()
        at = end.end() if end else at
        head, colon, tail = s.partition(": ")
        # "Sorry for that: ..." and "I can't see X, but from the graph: ..." lead in to an answer.
        for part in (head, tail) if colon and tail.strip() and (_FILLER.match(head) or declines(head, head.lower())) else (s,):
            if _WORD.search(part):
                yield part


def is_refusal(text: str) -> bool:
    if not any(map(text.lower().__contains__, _KEYS)):
        return False
    declined = False
    for s in sentences(_CODE.sub(" X ", text) if "`" in text or "~~~" in text else text):
        if declines(s, s.lower()) and not _SEARCHED.search(s):
            declined = True
        elif not _FILLER.match(s):
            return False
    return declined


def is_truncated(text: str) -> bool:
    fenced = "```" in text or "~~~" in text
    if fenced and sum(1 for _ in _FENCE.finditer(text)) % 2:
        return True
    prose = text.strip() if not fenced else re.sub(r"^[ \t]*(?:>[ \t]*)?(`{3,}|~{3,})[^\n]*\n.*?^[ \t]*(?:>[ \t]*)?\1[ \t]*$", "\n\x01\n", text, flags=re.S | re.M).strip()
    if prose.endswith("\x01"):
        return False
    paragraph = prose.replace("\x01", "").strip().split("\n\n")[-1]
    line = paragraph.split("\n")[-1].strip()
    if paragraph.count("`") % 2:
        return True
    bare = re.sub(r"`[^`\n]*`", "X", paragraph)
    # Numbering such as "a)" isn't an open bracket's end.
    plain = re.sub(r"(?m)^\s*(?:\d{1,3}|[a-z])\)", "", bare)
    for a, b in ("()", "[]", "“”", "«»", "„“"):
        if plain.count(a) > (plain.count(b) if (a, b) != ("„", "“") else plain.count("“") + plain.count("”")):
            return True
    if bare.count('"') % 2:
        return True
    if _ITEM.match(line):
        return bool(re.search(r"[,;:(\[]$", line)) or bool(_DANGLING.search(line) and not line.endswith("`"))
    end = line.rstrip(_CLOSERS + " ")
    if not end:
        return False
    if end.endswith(("...", "…")):
        return True
    if end[-1] in _ENDS:
        return False
    if end[-1] in ",;:([{—–-/\\&+=" and len(line) > 1:
        return not (line[-1] == ")" and end[-1] in ")")
    tail = line.split()[-1].strip(_CLOSERS)
    if re.search(r"[\w-]+\.[A-Za-z]{1,5}$", tail) and ("/" in tail or "\\" in tail or len(line.split()) == 1):
        return False
    if "/" in tail and len(line.split()) == 1:
        return False
    if paragraph.lstrip().startswith("|") and line.endswith("|"):
        return False
    tokens = re.sub(r"`[^`\n]*`", "\x02", line).split()
    if len(prose.split("\n")) == 1 and len(tokens) <= 3:
        # One word, number or code span, or several that are each complete by themselves.
        if len(tokens) == 1:
            return bool(_DANGLING.search(line))
        return not all(t.strip(_CLOSERS + ",.") == "\x02" or re.fullmatch(r"[\d.,%]+|[A-Z]{2,}|(?i:yes|no|oui|non|sí|si|ja|nein|sim|não|only|all|none|and|or)", t.strip(_CLOSERS + ",.")) for t in tokens)
    return True


def language(text: str) -> tuple[str, float, dict[str, float]]:
    """The best language (or script) of a text's prose, its lead over the next, and all scores."""
    prose = _CODE.sub(" ", text) if "`" in text or "~~~" in text else text
    plain = prose.isascii()
    if not plain:
        scripts: dict[str, int] = {}
        for c in _FOREIGN.findall(prose):
            name = unicodedata.name(c, "").split(" ")[0]
            if name != "LATIN":
                scripts[name] = scripts.get(name, 0) + 1
        if scripts and 2 * sum(scripts.values()) > sum(c.isalpha() for c in prose):
            name = max(scripts, key=scripts.get)
            lang = {"CYRILLIC": "ru", "CJK": "zh", "HIRAGANA": "ja", "KATAKANA": "ja"}.get(name, name)
            return "ja" if scripts.keys() & {"HIRAGANA", "KATAKANA"} else lang, float(sum(scripts.values())), {lang: 1.0}
    scores = [0.0] * len(_LANGUAGES)
    lower = prose.lower()
    # Paths and identifiers hold other characters than letters, or aren't in the lists.
    if "’" in lower:
        lower = lower.replace("’", "'")
    for run in lower.split():
        found = _SPEAKS.get(run)
        if found is None and not run.isalpha():
            run = run.strip(_MARKS)
            if "'" in run:
                for found in filter(None, map(_SPEAKS.get, run.split("'"))):
                    for lang in found[0]:
                        scores[lang] += found[1]
                continue
            found = _SPEAKS.get(run)
        if found is not None:
            for lang in found[0]:
                scores[lang] += found[1]
    if not plain:
        for letter, of in _LETTERS:
            if letter in lower:
                for lang in of:
                    scores[lang] += 1.0 / len(of)
    first, second = sorted(scores, reverse=True)[:2]
    return _LANGUAGES[scores.index(first)], first - second, dict(zip(_LANGUAGES, scores, strict=True))


def is_other_language(text: str, question: str) -> bool:
    said, ahead, said_scores = language(text)
    if ahead < 0.8:
        return False
    asked, lead, asked_scores = language(question)
    if asked == said or lead < 0.4:
        return False
    if any(lang == said and pattern.search(question) for lang, pattern in _ASKED.items()):
        return False
    return asked not in said_scores or said_scores[said] >= 1.4 * said_scores[asked] + 0.5


def defects(question: str | None, answer: str | None, context_question: str | None) -> list[str]:
    """Every rule that the pair triggers, in the order of RULES."""
    text, broken = stored_answer(answer)
    if not broken and is_empty(text):
        return ["empty"]
    asked = question if has_words(question) else context_question if has_words(context_question) else ""
    found = []
    if not broken and asked and is_copy(text, visible(asked)):
        found.append("copy")
    if is_refusal(text):
        found.append("refusal")
    if broken or is_truncated(text):
        found.append("truncated")
    if asked and is_other_language(text, visible(asked)):
        found.append("language")
    return found


def with_defects(messages: DataFrame, out: str = "defects") -> DataFrame:
    """`messages` with the array of triggered defects added; it is empty for a sound pair."""

    @arrow_udf(T.ArrayType(T.StringType(), False))
    def judge(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array([defects(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], type=pa.list_(pa.string()))

    return messages.withColumn(out, judge(F.col("question"), F.col("answer"), F.col("context_question")))


def defective(messages: DataFrame, every: bool = False) -> DataFrame:
    """(id, defect) once for each message id with a defective answer: the first rule, or `every` triggered one."""
    judged = with_defects(messages.select("id", "question", "answer", "context_question"), "defects").where(F.size("defects") > 0)
    picked = F.explode("defects") if every else F.get("defects", F.lit(0))
    return judged.select("id", picked.alias("defect")).distinct()
