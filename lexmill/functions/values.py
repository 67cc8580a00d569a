"""Word lists and tables that results depend on."""

# Stop words.
STOP_WORDS = """
и в во на к ко с со из у за по при о об обо от до под над перед после между про без через для около кроме меж
не нет же ли бы ну да или а но как что чтобы если когда куда откуда почему зачем где тогда там тут зато поэтому
это этот эта эти эту этим этом тот та то те того той тем том таким такая такое такие такой
он она оно они я мы вы ты его её ее их нам вам ними сам сама само сами самим самих самому самой
весь вся всё все всю всем всех каждый каждая каждое каждые только лишь даже ещё еще уже опять снова пока вновь
был была было были буду будешь будет будем будете будут есть нету может нельзя
который которая которое которые которого которому которым которых котором
кажется типа примерно почти ведь уж вроде либо ибо всего сейчас теперь
""".split()

# Words with their listed misspellings (some hold Latin letters).
MISSPELLINGS = {
    "путин": ["путен", "пуьин", "путтин", "пытин", "путеин", "пуин"],
    "зеленский": ["зеленскый", "зеленски", "зиленский", "зеленьский", "зелинский"],
    "трамп": ["трамб", "трампп", "трам", "трамм", "трумп"],
    "медведев": ["медвидев", "медведдев", "мидведев", "медвeдев"],
    "лавров": ["лавроф", "лавроов", "лаврав", "лавроw"],
    "байден": ["байдeн", "бaйден", "байдин", "бойден"],
    "россия": ["расия", "росия", "россиа", "рассия", "росcия"],
    "украина": ["укранна", "украйна", "укрина", "украинна", "укpaина"],
    "америка": ["амерка", "америкка", "амирика", "aмерика"],
    "китай": ["кытай", "китaй", "кетай"],
    "москва": ["масква", "моксва", "москав", "мосва", "моcква"],
    "петербург": ["питербург", "петерьург", "петербурк", "петeрбург"],
    "киев": ["кыев", "киив", "кеив", "кийев", "киeв"],
    "вашингтон": ["вашынгтон", "вашингтoн", "вашингтан", "ващингтон"],
    "президент": ["презедент", "президeнт", "призидент", "президнт"],
    "правительство": ["правитeльство", "правительтво", "правителство"],
    "парламент": ["парлaмент", "парламeнт", "парламнт"],
}
# Further valid words.
VALID_WORDS = """новости политика экономика общество спорт культура международный российский украинский американский
выборы санкции война мир договор соглашение министр депутат сенатор губернатор мэр""".split()
# Groups of words that sound alike; the first is the right one.
PHONETIC_GROUPS = [
    ["путин", "пуьин", "путен"],
    ["трамп", "трамб", "трумп"],
    ["байден", "бойден", "байдин"],
    ["москва", "масква", "моксва"],
    ["киев", "кыев", "кеив"],
    ["россия", "расия", "росия"],
    ["украина", "укрина", "украйна"],
    ["президент", "презедент", "призидент"],
    ["правительство", "правителство", "правитeльство"],
]
# Codes of letters by sound; the signs have none.
SOUND_LETTERS = "аоуыиеёэяюбпвфгкхдтжшщчзсцлмнрьъ"
SOUND_CODES = "00112222211122333445555666789A"
# The two keyboard layouts, key by key.
KEYS_LATIN = "qwertyuiop[]asdfghjkl;'zxcvbnm,./`~"
KEYS_CYRILLIC = "йцукенгшщзхъфывапролджэячсмитьбю.ёЁ"
# Words that count as right after a change of layout.
LAYOUT_CYRILLIC = """путин зеленский трамп байден медведев лавров президент министр правительство парламент депутат
выборы политика власть государство страна россия украина америка китай европа азия москва петербург киев вашингтон
лондон париж новости экономика общество культура спорт международный российский украинский американский война мир
договор соглашение санкции который сказать время человек работа жизнь день рука делать вопрос дом сторона образ
место право слово дело голова ребенок сила конец вид система часть город отношение""".split()
LAYOUT_LATIN = """putin trump biden ukraine russia america china moscow kiev washington london paris berlin president
minister government parliament election news politics economy society sport culture""".split()
# A word and its kinds, synonyms both ways.
SPORT = "спорт"
SPORT_KINDS = ["хоккей", "футбол", "баскетбол", "теннис", "волейбол", "бокс", "плавание", "легкая атлетика"]
# Categories of articles, in the order they are tried.
CATEGORIES = ["Политика", "Общество", "Наука", "Экономика", "Статьи"]
# Paths that no article has.
EXCLUDED_PATHS = ["/login", "/register", "/about", "/contact", "/search", "/tag", "/author", "/hall-of-fame", "/member/", "/help", "/help/"]
# What a label of relevance says, how sure it is taken to be, and its default reason.
LABEL_TEXT = {0: "нерелевантно", 1: "частично релевантно", 2: "очень релевантно"}
LABEL_CONFIDENCE = {0: 0.1, 1: 0.6, 2: 0.9}
LABEL_REASON = {0: "Документ не отвечает на запрос", 1: "Документ затрагивает тему, но косвенно", 2: "Документ напрямую раскрывает тему запроса"}
# The judge's instructions, part of the training rows.
JUDGE_PROMPT = """Ты судья релевантности результатов поиска. Оцени соответствие документа запросу пользователя.
Верни только компактный JSON:
{"label":0|1|2,"confidence":0-1,"reason":"краткий текст"}
Где:
  - label=0 (нерелевантно) если документ не отвечает на запрос
  - label=1 (частично) если документ затрагивает тему, но косвенно
  - label=2 (релевантно) если документ напрямую раскрывает тему запроса
confidence – твоя уверенность (0..1). reason – объяснение на русском до 20 слов.
Внутри поля reason не используй кавычки, фигурные/квадратные скобки или перевод строки, только простой текст.
Не добавляй текст до или после JSON. Не используй комментарии."""
# English stop words, the default of the index analyzer.
ENGLISH_STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
