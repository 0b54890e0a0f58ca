"""Word lists, weights and limits that results depend on."""

# fixed values: words that event grouping leaves out
KEYWORD_STOPS = """
the and for are was were has have had will would could should may might not its this that from with says said after than
more also over new first last also into been being about where when who what how
это так уже всё один два три без если том тем над под через между после при всех всем
""".split()

# fixed values: words that card signatures leave out
SIGNATURE_STOPS = """
the and for are was were has have had will would could should may might not its this that from with says said after than
more also over new first last into about been being where when who what how why
это так уже всё если том тем над под через между после при всех всем для что как его она они оно все
""".split()

# fixed values: capitalised words that are no organisations
CAPITAL_STOPS = """
the a an is are was were will has have this that these those new first last next today yesterday tomorrow report reports
analysis breaking update news how why what when where january february march april may june july august september october
november december monday tuesday wednesday thursday friday saturday sunday
""".split()

# fixed values: weight of each kind of entity
ENTITY_WEIGHTS = {"organizations": 0.40, "products": 0.35, "people": 0.15, "topics": 0.10}

# fixed values: sources whose titles are taken first, in order
PREFERRED_SOURCES = """
rss:reuters rss:bbc_world rss:guardian rss:aljazeera rss:tass rss:rbc_news rss:kommersant rss:lenta_news rss:lenta_russia rss:mos_gov
rss:techcrunch_ai rss:huggingface rss:ai_news rss:ign rss:kotaku rss:gamespot rss:pcgamer rss:techcrunch rss:theverge rss:arstechnica
tg:pekagame tg:DyadyaLyoshaChannel tg:varlamov_news rss:anthropic rss:google_ai rss:github_blog rss:langchain rss:simon_willison
rss:latent_space rss:techcrunch_ai rss:theverge_ai rss:infoq_ai tg:neuraldvig
""".split()

# fixed values: sections in the order of a digest, their names and signs
SECTION_ORDER = ["world", "russia_moscow", "ai_agents", "tech", "ai", "games"]
SECTION_NAMES = {
    "world": "Мировые новости",
    "russia_moscow": "Россия и Москва",
    "ai": "AI и нейросети",
    "games": "Игры",
    "ai_agents": "AI-агенты и инструменты",
    "tech": "Технологии",
    "moscow": "Москва",
}
SECTION_SIGNS = {"world": "🌍", "russia_moscow": "🇷🇺", "ai": "🤖", "games": "🎮", "ai_agents": "🧠", "tech": "💻", "moscow": "🏙"}
RU_MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()

# fixed values: base weight of each section for the reader
SECTION_WEIGHTS = {"ai_agents": 1.0, "ai": 0.95, "tech": 0.9, "russia_moscow": 0.8, "world": 0.75, "games": 0.65}

# fixed values: words of each section that the reader cares for
SECTION_KEYWORDS = {
    "ai_agents": [
        "openclaw", "agent", "coding agent", "mcp", "tool call", "browser", "memory", "voice", "search", "local model", "ollama",
        "routing", "orchestration", "agent framework", "plugin", "claude", "openai", "anthropic", "langchain", "cursor", "copilot",
        "agentic", "workflow", "function call", "llm stack", "tool use", "skill", "autonomous",
    ],
    "ai": [
        "llm", "gpt", "claude", "gemini", "llama", "model", "inference", "fine-tun", "rag", "embedding", "vector", "benchmark",
        "reasoning", "multimodal", "context window", "open source model", "weights",
    ],
    "tech": [
        "apple", "mac", "macbook", "apple silicon", " m1", " m2", " m3", " m4", "developer", "ide", "vscode", "github", "automation",
        "docker", "open source", "rust", "golang",
    ],
    "games": [
        "release", "launch", "announced", "trailer", "studio", "sony", "microsoft", "nintendo", "valve", "steam", "indie", "rpg", "fps",
        "open world", "game development",
    ],
    "russia_moscow": [
        "москва", "метро", "транспорт", "перекрытие", "дтп", "протест", "суд", "закон", "мэрия", "правительство", "улица", "центр",
        "район", "происшествие", "штраф", "кремль", "арест", "митинг",
    ],
    "world": [
        "война", "конфликт", "war", "conflict", "economy", "trade", "sanctions", "election", "president", "nato", "un", "climate",
        "energy", "market", "crisis", "геополитика", "переговоры", "блокада",
    ],
}

# fixed values: fragments of trusted source names, everywhere and by section
TRUSTED = """
reuters apnews bbc guardian nytimes washingtonpost ft.com economist techcrunch theverge wired arstechnica simonwillison latent.space
kommersant vedomosti rbc meduza anthropic openai google microsoft github huggingface langchain
""".split()
TRUSTED_IN = {
    "ai_agents": "anthropic openai google langchain huggingface simonwillison latent.space github cursor".split(),
    "ai": "anthropic openai deepmind mistral huggingface techcrunch theverge latent.space".split(),
    "tech": "techcrunch theverge arstechnica wired apple.com github microsoft".split(),
    "world": "reuters apnews bbc guardian ft.com economist nytimes washingtonpost".split(),
    "russia_moscow": "kommersant vedomosti rbc meduza tass fontanka mos.ru".split(),
    "games": "ign gamespot kotaku steam shazoo nintendo sony microsoft valve".split(),
}

# fixed values: words that make an event of a section important
SIGNALS = {
    "world": [
        "война", "war", "attack", "election", "president", "nato", "блокада", "санкции", "sanctions", "crisis", "конфликт", "nuclear",
        "treaty", "ceasefire", "summit", "explosion", "major", "global", "international",
    ],
    "russia_moscow": [
        "арест", "суд", "протест", "закон", "мэрия", "кремль", "путин", "перекрытие", "происшествие", "взрыв", "пожар", "министр",
        "правительство", "запрет", "обыск", "задержан",
    ],
    "ai_agents": [
        "release", "released", "launch", "announced", "new model", "new agent", "новая модель", "выпустил", "запустил", "gpt", "claude",
        "gemini", "llama", "open source",
    ],
    "ai": [
        "release", "released", "launch", "model", "benchmark", "breakthrough", "outperforms", "new", "open source", "state of the art",
        "sota",
    ],
    "tech": ["apple", "google", "microsoft", "amazon", "ipo", "billion", "launch", "release", "new product", "open source"],
    "games": ["release", "launch", "announced", "major", "ps5", "xbox", "nintendo", "new game", "sequel", "remake", "goty"],
}

# fixed values: weights of importance, relevance, freshness and source, by section and otherwise
SCORE_WEIGHTS = {
    "world": (0.40, 0.25, 0.20, 0.15),
    "russia_moscow": (0.30, 0.35, 0.20, 0.15),
    "ai_agents": (0.22, 0.48, 0.15, 0.15),
    "ai": (0.28, 0.42, 0.15, 0.15),
    "tech": (0.30, 0.35, 0.20, 0.15),
    "games": (0.25, 0.38, 0.27, 0.10),
}
OTHER_WEIGHTS = (0.33, 0.33, 0.19, 0.15)

# fixed values: minutes a build needs by provider, its limits, and how history changes it
BUILD_MINUTES = {"groq": 15, "cerebras": 15, "gemini": 20, "mistral": 20, "openai": 30, "anthropic": 30, "openrouter": 30, "deepseek": 40}
BUILD_LEAST, BUILD_MOST, BUILD_FACTOR, BUILD_SAMPLES, BUILD_OTHER = 5, 120, 1.3, 7, 30

# fixed values: feedback words left out of negative keywords
FEEDBACK_STOPS = "http https www com html idx rss feed news".split()

# fixed values: what an image address looks like
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".gif")
IMAGE_PATHS = ("/image", "/media/", "/uploads/", "/content/", "/wp-content/")

# fixed values: thumbnails that are no images
NO_THUMBNAILS = ("self", "default", "nsfw", "spoiler", "")

# fixed values: patterns that find a page's announced image and its first one
IMAGE_META = r"""(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']"""
IMAGE_TAG = r"""(?i)<img[^>]+src=["']([^"']+)["']"""

# fixed values: usual places of feeds
FEED_PATHS = ("/feed", "/feed/", "/rss", "/rss.xml", "/atom.xml", "/index.xml")

# fixed values: patterns of products with numbers, quoted names and capitalised names
NUMBERED_NAME = r"(?U)\b([A-Za-z]{2,}[-\s]?\d+(?:\.\d+)?)\b"
QUOTED_NAME = "[\"“«']([^\"”»']{2,40})[\"”»']"
CAPITAL_NAME = r"(?U)\b([A-Z][A-Za-z0-9]{1,}(?:\s+[A-Z][A-Za-z0-9]{1,}){0,3})\b"

# fixed value: what no name begins or ends with
NAME_EDGES = ".,;:!?()[]{}"

# fixed values: texts that mark a card as unfinished: anywhere, and at its start
LEFTOVERS = ("```", "  Tags:", "&amp;#", "&#x")
LEFTOVER_START = "Tool:"
LEFTOVER_PAIR = ("Release:", "Datasette")

# fixed values: tags of the answers that cards are made of
CARD_TAGS = ["ЗАГОЛОВОК", "СУТЬ", "ПОЧЕМУ ВАЖНО", "РЕДАКЦИОННЫЙ КОММЕНТАРИЙ"]
AGENT_TAGS = ["ЗАГОЛОВОК", "ЧТО ПРОИЗОШЛО", "ПОЧЕМУ ВАЖНО", "ЗОНА ВЛИЯНИЯ", "ДОСТОВЕРНОСТЬ"]

# fixed values: lines and marks of a digest
WHY_LINE = ("<blockquote><i>Почему важно:</i> ", "</blockquote>")
TAKE_LINE = "<i>Редакция:</i> "
AREA_LINE = "<i>Зона влияния:</i> "
LINKS_SIGN = "🔗 "
HEADLINE_HEAD = "⚡ <b>Главное</b>"
HEADLINE_TAGS = "#главное #world"
RADAR_HEAD = "📡 <b>На радаре</b>"
ISSUE_SIGN = "📰"
ISSUE_NAME = "Утренний дайджест"
# fixed values: name, heading and sources of each part of a digest, in order
ISSUE_PARTS = [
    ("world", "🌍 <b>Мировые новости</b>\n#world", ("world",)),
    ("russia_moscow", "🇷🇺 <b>Россия и Москва</b>\n#Москва", ("russia_moscow",)),
    ("ai", "🤖 <b>AI и технологии</b>\n#ai", ("ai_agents", "ai", "tech")),
    ("games", "🎮 <b>Игры</b>\n#games", ("games",)),
]

# fixed values: days of the week in block times
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

# fixed values: key of the state row that pauses delivery
PAUSE_KEY = "__digest_pause__"
