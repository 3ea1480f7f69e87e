"""Word lists that some operators take as parameters.

Callers may give their own; results depend on the lists only through these
parameters.
"""

from __future__ import annotations

#: Common function words by language.
STOPWORDS = {
    "en": ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "he", "i", "in", "is", "it", "me", "my", "not", "of", "on", "or", "she", "so", "that", "the", "they", "this", "to", "was", "we", "with", "you"),
    "de": ("als", "auf", "aus", "das", "dem", "den", "der", "des", "die", "ein", "eine", "er", "es", "für", "ich", "im", "in", "ist", "mit", "nicht", "sich", "sie", "und", "von", "zu"),
    "fr": ("au", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "je", "la", "le", "les", "ne", "pas", "pour", "que", "qui", "sur", "un", "une"),
    "es": ("a", "al", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"),
}
#: Words that no list of top words, print or signature counts, in English and the south Slavic languages.
ALL_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "of", "to", "in", "on", "at", "by", "for", "with", "as", "is", "are", "was", "were", "be", "been", "being",
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "this", "that", "these", "those",
    "so", "do", "don", "t", "s", "m", "re", "ve", "ll", "d", "yeah", "oh", "uh", "yo", "ay", "hey", "na", "la",
    "u", "se", "je", "su", "te", "ti", "ja", "mi", "vi", "ona", "ono", "oni", "one", "moj", "tvoj", "njegov", "njen", "naš", "vaš", "njihov", "što", "šta",
    "ko", "ali", "ili", "pa", "da", "ne", "nije", "neka", "ako", "kao", "samo", "sad", "još", "već", "sve", "svi", "kad", "tad", "tu", "tamo", "ovde", "ovo",
    "taj", "ova", "onaj", "bez", "od", "za", "po", "iz", "kroz", "uz", "niz", "pred", "pod", "nad", "među", "bih", "bi", "bismo", "biste", "ću", "ćeš", "će",
    "ćemo", "ćete", "jer", "biti", "jako", "si", "sam", "smo", "ste", "kô", "k'o", "li", "nek",
)
#: Patterns of titles of pages that are no songs, which weak labels go by.
NO_SONG_TITLES = (
    r"\binterview\b", r"\bthe making of\b", r"\bmaking of\b", r"\bbehind the scenes\b", r"\bin conversation\b", r"\bannotat", r"\bdirectors? commentary\b", r"\breacts? to\b",
    r"\bresponds? to\b", r"\bconference call\b", r"\bvmas?\b", r"\bbet awards?\b", r"\bamerican music awards\b", r"\boscars\b", r"\bsuper ?bowl\b", r"\bhalftime\b",
    r"\bbillboard music awards?\b", r"\bmtv (video|movie) awards?\b", r"\bacademy of country\b", r"\biheartradio\b", r"\bartist of the (decade|year|month)\b", r"\bgrammy awards?\b",
    r"\blatin grammys?\b", r"\bacceptance speech\b", r"\bvictory speech\b", r"\baward acceptance\b",
    r"\btour (costumes?|book|guide|dates?|rehearsals?|diary|programme?|setlist|special guests?|intro)\b", r"\bsetlist\b", r"\bforeword\b", r"\bprologue\b", r"\bepilogue\b", r"\bpreface\b",
    r"\bliner notes\b", r"\bbooklet\b", r"\bplaylist\b", r"\bchart history\b", r"\bdiscography\b", r"\btracklist", r"\bgreatest hits\b",
    r"\binstagram (post|story|stories|live|caption|rant|feed)\b", r"\bfacebook post\b", r"\btwitter (rant|thread)\b", r"\btweetstorm\b", r"\ba message from\b", r"\bmessage from\b",
    r"\bcommencement\b", r"\bted talk\b", r"\bkeynote\b", r"\bscreenplay\b", r"\bfilm script\b", r"\bmovie script\b", r"\btranscript\b", r"\bdocumentary\b", r"\balbum art\b", r"\bcover art\b",
    r"\bpress (release|conference)\b", r"\bofficial statement\b", r"\btraducci[óo]n\b", r"\btradu[çc][ãa]o\b", r"\bt[üu]rk[çc]e\b", r"\b[çc]eviri\b", r"\bs[öo]zleri\b", r"\bromaniz",
    r"\b[üu]bersetzung\b", r"\bperevod\b",
)
#: Title words that guard a song against the junk rules.
GUARDS = ("freestyle", "interlude", "skit", "reprise", "instrumental")
#: Parts of titles that mark scripts, talk and events.
NOT_SONGS = (
    "interview", "discography", "tracklist", "tracklisting", "booklet", "conference call", "setlist", "annotated", "tour dates", "album art", "cover art", "liner notes",
    "press release", "(album)", "full album", "q&a", "biography", "snippet", "teaser",
    "script", "screenplay", "monologue", "speech", "acceptance", "transcript", "commencement", "eulogy", "ted talk", "press conference", "manifesto", "open letter",
    "statement", "essay", "poem", "vmas", "vma performance", "bet awards", "grammy", "oscars", "super bowl", "halftime", "medley", "documentary", "trailer", "announcement",
    "phone conversation", "phone call with", "philosophy book", "the future of music",
)
#: Further junk in titles as patterns, and titles that are exceptions from it.
JUNK_PARTS = (
    r"\(live\)", r"\[live\]", "live from", r"\bvoice memo\b", r"\bcommentary\b", r"\btour\b", r"\bbehind the scenes\b", r"\binterview\b", r"\bmaking of\b", r"\bdemo\b", r"\bkaraoke\b",
    r"\btribute\b", r"\bprologue\b", r"\bpaused\b", r"\bpiano/vocal\b", r"\bchart history\b", r"\bforeword\b", r"\bperformance\b", " / .* / ",
)
JUNK_EXCEPTIONS = ("long live", "live forever", "live for the little things")
JUNK_ALL_THE_SAME = ("live/2011", "live 2011", "new years day")
#: English marker words.
ENGLISH = ("the", "and", "to", "of", "a", "i", "you", "it", "in", "my", "is", "that")
#: Parts of titles that keep a song out of the highlights.
DEMOS = ("(demo)", "[demo]", "(snippet)", "[snippet]", "(teaser)", "[teaser]", "(promo)", "[promo]", "(skit)", "[skit]")
#: Parts of names that stand for no artist, in either kind of dump.
NO_ARTIST_PAGES = ("genius", "translation", "romanization", "spotify", "apple music", "soundcloud", "annotated", "tracklist", "booklet")
NO_ARTIST_TRACKS = ("various artists", "soundtrack", "original cast", "karaoke", "tribute", "unknown artist", "genius", "translation")
#: Words that mark a release variant of the same song.
DESCRIPTORS = (
    "music video", "official video", "lyrics? video", "official audio", "visualizer", "sped up", "slowed down", "slowed", "reverb", "acoustic", "live", "remix", "mix",
    "instrumental", "karaoke", "demo", "remaster(?:ed)?", "radio edit", "single version", "album version", "extended", "bonus track", "mono", "stereo", "deluxe", "edit", "version",
    "taylor'?s version", "from the vault", "cover", "mashup", "bootleg", "rerecord(?:ed)?", "re-record(?:ed)?", "mv",
)
#: Words that make a bracket or dash clause a version, and those that make it a remix.
VERSION_WORDS = (
    "remix(?:ed)?", "mix", "edit", "rework", "bootleg", "dub", "version", "flip", "refix", "vip", "remode", "re-?edit", "cover", "live", "acoustic", "instrumental", "a ?capp?ella",
    "sped up", "slowed", "demo", "snippet", "teaser", "preview", "remaster(?:ed|i[sz]ad[ao]|is[ée]e?)?", "mono", "stereo", "ao vivo", "en vivo", "en directo",
)
REMIX_WORDS = ("remix(?:ed)?", "mix", "edit", "rework", "bootleg", "dub", "flip", "refix", "vip", "re-?edit")
#: Medleys, fragments between songs, and talk.
MEDLEYS = ("megamix", "mega[- ‐]mix", "medley", "mash-?up", "megamashup")
INTERLUDES = ("interlude", "intro", "introductions?", "outro", "prologue", "speaks", "dialog(?:ue)?")
TALK = (
    "voice[- ]?over", "voice memo", "interview", "commentary", "track by track", "radio promo", "spoken intro", "audio book", "audiobook", "behind the scenes", "album preview",
    "phone call with", "phone conversation", "press conference", "acceptance speech", "liner notes", "tracklist", "full album", "spoken interlude", "band introductions?", "band intros?",
    "introducing the band", "pr[ée]sentation des musiciens", "radio spot", "announcements?", "halftime show", "promotional spot", "radio commercial", "tour promo", "album ad",
    "session highlights", "studio banter",
)
#: Names that are no one artist.
PSEUDO_ARTISTS = (
    "various.*", "va", r"v\.a\.", "v a", r"aa\.? ?vv\.?", "diverse.*", "verschiedene.*", "varios.*", "v[aá]rios.*", "vari", "autori vari", "artistes? divers", "compilation.*", "unknown.*",
    "artist", "artists", "song", "songs", "the", "a", "y", "e", "x", "n/a", "none", "null", "undefined", "kidz bop.*", "glee cast", "karaoke.*", "sing king.*", "the hit crew.*",
    "party hits.*", r"mr\.? entertainer.*", "ameritz.*", "hit masters.*", "starlite.*", ".*tribute.*", ".*cover band.*", r".*covers?\b.*", ".*orchestra",
)
#: Words sung but not said, and words of labels and credits.
SYLLABLES = (
    "la", "na", "da", "dah", "ooh", "ohh", "aah", "ah", "oh", "uh", "eh", "ey", "ay", "yeah", "yah", "yo", "mm", "hmm", "ba", "bum", "whoa", "woah", "wah", "ha", "hey", "oi", "ra", "ta",
    "ti", "di", "du", "lo", "le", "li", "nah", "yea", "ye", "wo", "wa", "ho", "oo", "ai", "ya", "yu", "yi", "hi", "hu", "hah", "heh", "huh", "hum", "shh", "ssh", "tsk", "brr", "grr",
)
INTERJECTIONS = ("wow", "ugh", "mwah", "muah", "meh", "bleh", "aha", "umm", "uhm", "pow", "baow", "sheesh")
LABELS = ("chorus", "choruses", "refrain", "refrains", "repeat", "instrumental", "verse", "ref", "refr", "coro", "estribillo", "ritornello", "rit", "refrão", "intro", "outro", "prechorus", "copyright", "reserved")
#: Spellings of grammar that are grammar for English singers alone.
EN_SPELLINGS = (
    "cos", "coz", "cus", "cah", "kuz", "dont", "cant", "wont", "aint", "thats", "youre", "youve", "youll", "youd", "ive", "isnt", "arent", "wasnt", "werent", "doesnt", "didnt",
    "couldnt", "wouldnt", "shouldnt", "hes", "shes", "theyre", "theyve", "theyll", "theres", "heres", "whats", "whos", "weve", "lets", "somethin", "nothin", "everythin",
    "anythin", "goin", "comin", "gettin", "havin", "makin", "sayin", "bein",
)
#: Ranges of scripts whose vowel signs tokens drop.
SPLIT_SCRIPT = r"[\x{0900}-\x{0DFF}\x{0E00}-\x{0EFF}\x{0F00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}]"
CREDITS = ("copyright", "rights", "reserved", "ascap", "bmi", "socan", "publishing", "administered")
