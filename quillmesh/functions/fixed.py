"""Values that results depend on: lists, vocabularies, word lists and patterns."""

from __future__ import annotations

import re

# Residential lists, and the default lists.
RESIDENTIAL_LISTS = ("WHITMANWIRE", "BUTLERBUZZ", "ROCKYWIRE", "RE-INNFORMER", "MATHEYMAIL", "HUOHUB", "YEHYELLOWPAGES")
DEFAULT_LISTS = (*RESIDENTIAL_LISTS, "FREEFOOD")
LIST_HOST = "lists.princeton.edu"
ARCHIVE_BASE = "https://lists.princeton.edu/cgi-bin/wa"
SAFELINKS = ".safelinks.protection.outlook.com"
TIME_ZONE = "America/New_York"
ONLINE_ID = "online"
RELAY_NAME = "HoagieMail"
RELAY_ADDRESS = r"(?i)^(?:hoagie|hoagiemail)@princeton\.edu$"
DEFAULT_SENDER = "Princeton community"

# Event tags in order, and the keyword pattern of each.
TAG_RULES = {
    "free food": r"\bfree\s+(?:food|pizza|boba|bubble tea|donuts?|doughnuts?|lunch|dinner|breakfast|brunch|snacks?|bagels?|coffee|dessert|ice cream|cookies|tacos|sushi|dumplings)\b|\bfood (?:will be |is )?(?:provided|served)\b|\b(?:dinner|lunch|refreshments|snacks) (?:will be )?(?:provided|served)\b|\bstudy break\b",
    "career": r"\b(?:career|recruit(?:ing|ment)?|internships?|job fair|info(?:rmation)? session|coffee chat|resume|interview prep|networking|hiring)\b",
    "research": r"\b(?:research|thesis|junior paper|\bJP\b|lab (?:open house|tour)|symposium|poster session)\b",
    "academics": r"\b(?:lecture|seminar|colloquium|office hours|course|precept|academic|study session|tutoring|workshop on)\b",
    "tech": r"\b(?:hackathon|coding|programming|software|machine learning|\bAI\b|artificial intelligence|computer science|tech talk|developer|web dev|app dev|robotics)\b",
    "entrepreneurship": r"\b(?:startup|start-up|entrepreneur(?:ship|ial)?|founders?|venture|pitch (?:night|competition)|e-club|keller center)\b",
    "politics": r"\b(?:politic(?:s|al)|election|voting|voter|campaign|policy|debate|democra(?:cy|tic)|republican|congress|senator|whig-clio)\b",
    "visual arts": r"\b(?:art exhibit(?:ion)?|gallery|painting|drawing|sculpture|photography|printmaking|art museum|studio art|ceramics)\b",
    "performing arts": r"\b(?:theat(?:er|re)|musical|play\b|dance (?:show|performance)|improv|comedy show|stand-up|a cappella|auditions?|recital|performance)\b",
    "literature": r"\b(?:poetry|poems?|book (?:club|talk|launch)|reading series|literary|author talk|creative writing)\b",
    "culture": r"\b(?:cultural|heritage|diwali|lunar new year|holi|eid|hanukkah|diaspora|international students?|culture night|festival)\b",
    "music": r"\b(?:concert|band|orchestra|choir|jazz|dj\b|open mic|a cappella|recital|music)\b",
    "gaming": r"\b(?:game night|board games?|video games?|esports|smash|chess|poker|trivia)\b",
    "athletics": r"\b(?:game vs\.?|match vs\.?|tournament|intramural|athletics|varsity|club sports?|5k|run club|pickup (?:basketball|soccer|game))\b",
    "religion": r"\b(?:worship|prayer|bible study|shabbat|mass\b|chaplain|faith|interfaith|church service|mosque|temple|jummah|religious)\b",
    "sustainability": r"\b(?:sustainab(?:le|ility)|climate|environment(?:al)?|recycling|composting|carbon)\b",
    "outdoors": r"\b(?:hike|hiking|outdoor action|camping|kayak|canoe|picnic|garden(?:ing)?|nature walk|bike ride)\b",
    "wellness": r"\b(?:wellness|mental health|mindfulness|meditation|yoga|self-care|therapy dogs?|stress relief|CPS|UHS)\b",
    "community service": r"\b(?:volunteer(?:ing)?|community service|service project|donation drive|pace center|mentoring|tutoring kids)\b",
    "speaker event": r"\b(?:speaker|talk by|keynote|fireside chat|panel(?:ists)?|in conversation with|guest lecture|q&a with)\b",
    "social event": r"\b(?:party|social|mixer|study break|celebration|formal|gala|meet(?:-| and )greet|hang ?out|karaoke|movie night|screening)\b",
    "stem": r"\b(?:physics|chemistry|biology|mathematics|math\b|engineering|neuroscience|astrophysics|statistics|STEM)\b",
}
EVENT_TAGS = tuple(TAG_RULES)

# Message categories in order of precedence.
CATEGORY_RULES = (
    ("Free food", r"free\s+(food|pizza|boba|donuts|doughnuts|lunch|dinner|snacks)|food is provided|leftover|food.*(?:available|up for grabs)"),
    ("Opportunities", r"application|apply\b|internship|hiring|recruit|fellowship|paid study|paid research|job\b"),
    ("Arts & culture", r"\bconcert|\baudition|\btheat(?:er|re)|\bdance\b|orchestra|a cappella|art exhibit|poetry|film screening|museum"),
    ("Academics", r"lecture|seminar|colloquium|research|professor|department|symposium|office hours|course\b"),
    ("Events & socials", r"rsvp|party|social|celebrat|join us|tonight|open house|picnic|workshop|tournament|game night|meeting"),
)
DEFAULT_CATEGORY = "Campus life"
ARTS = ("Arts", "Dance", "Music", "A Cappella", "Performing Arts")

# Topics of the official feed and the tags they mean.
TOPIC_TAGS = {
    "Career Development": "career", "Networking": "career", "Information Session": "career", "Lecture/Talk": "speaker event", "Speaker/Lecture": "speaker event",
    "Social Event": "social event", "Social": "social event", "Performance": "performing arts", "Arts & Culture": "culture", "Cultural": "culture",
    "Athletics/Recreation": "athletics", "Sports": "athletics", "Community Service": "community service", "Service": "community service", "Health & Wellness": "wellness",
    "Wellness": "wellness", "Religious": "religion", "Religious/Spiritual": "religion", "Academic": "academics", "Training/Workshop": "academics",
    "Research": "research", "Political": "politics", "Sustainability": "sustainability", "Food": "free food",
}

# Signs of events, and of what is none.
EVENT_WORDS = r"\b(?:join us|come (?:to|out|by|join)|rsvp|event|talk|workshop|info(?:rmation)? session|study break|meeting|panel|screening|performance|concert|game night|tabling|open house|party|social|mixer|dinner|lunch|brunch|tournament|hackathon|lecture|seminar|colloquium|reading|exhibit(?:ion)? opening|tryouts?|auditions?|showcase|fair|celebration|vigil|service|mass|ceremony|kickoff|meetup|gathering)\b"
NOT_EVENT = r"\b(?:for sale|selling|sublet(?:ting)?|lost (?:and|&) found|lost my|found a|looking for (?:a |an )?(?:roommate|ride|tutor)|survey|paid (?:research )?study|participants? needed|job opening|now hiring|applications? (?:are )?(?:open|due)|apply (?:now|by|here)|deadline|newsletter|weekly digest|this week at|due (?:in|by|on|tonight|tomorrow|today)|apply (?:for|to)|applications?\b|register by|sign ?up by|submissions?\b|\[apply\]|call for (?:papers|submissions|applications))\b"
ONLINE = r"\bzoom\.us/|\b(?:on|via|over|through) (?:zoom|google meet|microsoft teams|teams)\b|\bzoom (?:link|meeting|call)\b|\bwebinar\b|\blivestream(?:ed)? (?:at|on|via)\b"
DEADLINE_TIME = r"\b(?:11:59\s*(?:pm|p\.m\.)?|23:59)\b"
RELATIVE = r"\b(?:in|within|next)\s+\d+\s*(?:hours?|hrs?|minutes?|mins?|days?|weeks?)\b|\bnow\b|\bago\b"
RSVP_URL = r"forms\.gle|docs\.google\.com/forms|eventbrite\.|partiful\.com|lu\.ma/|luma\.com|rsvp|tigerhub|my\.princeton\.edu/rsvp|campusgroups"

# Parts of a subject that aren't its title.
TITLE_LEAD = r"^(?:TODAY|TONIGHT|TOMORROW|TMRW|THIS \w+|REMINDER|LAST CHANCE|NOW|NEW)\s*[:!\-–—|]+\s*"
TITLE_LOGISTICS = r"\s+(?:[-–—|:(]\s*)?(?:(?:this|next|on)\s+)?(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\b|tonight\b|tomorrow\b|tmrw\b|today\b|(?:@|at)\s*\d{1,2}(?::\d{2})?\s*(?:am|pm)?\b|\d{1,2}/\d{1,2}\b)"
LOCATION_LABEL = r"(?:^|\n)\s*(?:📍|\*?\s*(?:location|where|place|venue|room)\s*\*?\s*[:\-–—])\s*([^\n]{2,120})"
LOCATION_PIN = r"📍\s*([^\n]{2,120})"
LOCATION_PHRASE = r"\b(?:in|at|@|by|outside|inside|near|on)\s+((?:the\s+)?(?:[A-Z][\w'’&.\-/]*|\d{1,4}[A-Z]?)(?:\s+(?:[A-Z0-9][\w'’&.\-/]*|of|and|for|the|&|[A-Z]?\d{1,4}[A-Z]?))*)"

# Delivery boilerplate.
_LISTS = "|".join(RESIDENTIAL_LISTS)
SUBSCRIBER_NOTICE = rf"(?i)^\s*This email was sent to you as a subscriber of (?:{_LISTS})@princeton\.edu\.\s*"
FORMS_WARNING = r"(?i)^\s*⚠️?\s*SECURITY WARNING\s*This email links to a Google Form\.\s*Do not\s+enter your password or Duo code\s+in the form\.\s*Princeton University will never ask for your login credentials\.\s*If the message is suspicious, report it to the Phish Bowl at\s+phishbowl@princeton\.edu\.?\s*"
FORMS_WARNING_TEXT = "⚠ SECURITY WARNING This email links to a Google Form. Do not enter your password or Duo code in the form. Princeton University will never ask for your login credentials. If the message is suspicious, report it to the Phish Bowl at phishbowl@princeton.edu"
UNSUBSCRIBE_URL = rf"https://lists\.princeton\.edu/cgi-bin/wa\?SUBED1=(?:{_LISTS})(?:&A=1)?"
UNSUBSCRIBE = rf"""(?i)If you would like to unsubscribe from this listserv, please send a ["“]SIGNOFF (?:{_LISTS})["”] command to LISTSERV@PRINCETON\.EDU\.?|To unsubscribe(?: from the (?:{_LISTS}) list)?, click the following link:\s*\[?{UNSUBSCRIBE_URL}\]?(?![\w&=/-])"""
RELAY_FOOTER = "This email was instantly sent to all college listservs with"
RELAY_MARKS = (r"(?i)Hoagie\s*Mail", "Email composed by", "hoagie@princeton.edu")
RELAY_END = r"(?i)please report it to\s+hoagie@princeton\.edu(?:\s*\[mailto:hoagie@princeton\.edu\])?\s*\."
RELAY_AUTHOR = r"(?i)Email composed by\s+(.{1,160}?)\s*\(\s*([A-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Z0-9.-]+\.[A-Z]{2,})\s*\)"
TRANSPORT_SENDER = r"^(hoagie ?mail|hoagie|listserv|princeton community)$"
CONTENT_END = r"(?i)This email was instantly sent|You are receiving this email because|To unsubscribe from|Sent (?:using|via) HoagieMail|Powered by (?:{products})|\nOn .{{1,160}}wrote:|-----Original Message-----"
#: Applications whose "Powered by" line ends a message's own words; a deployment names its own besides.
POWERED_BY = ("Hoagie",)
HTML_TAG = r"(?i)</?(?:html|body|head|div|p|span|br|hr|a|img|table|tbody|thead|tr|td|th|ul|ol|li|h[1-6]|strong|b|em|i|u|s|del|sup|sub|font|center|figure|figcaption|blockquote|pre|code|script|style|iframe|svg)(?=[\s/>])[^>]*>"

# Aliases that are strong, or weak, whatever their form.
STRONG_ALIASES = ("hackprinceton", "bodyhype", "disiac", "naacho", "wprb", "sympoh", "dorobucci")
WEAK_ALIASES = ("all nighter", "public lectures", "academic advising", "research computing", "campus club")

# Websites that belong to no organization.
SHARED_SITES = r"(?i)^https?://(?:www\.)?(?:princeton\.edu|my\.princeton\.edu|instagram\.com|facebook\.com|linktr\.ee|docs\.google\.com|forms\.gle|sites\.google\.com)/?$"

# Kinds of places on the map, and the eating clubs.
POI_CATEGORIES = {
    "university": "academic", "residential_college": "residential", "library": "library", "theatre": "social", "events_venue": "social", "gallery": "social", "museum": "social",
    "cafeteria": "dining", "cafe": "dining", "food_court": "dining", "restaurant": "dining", "sports_centre": "athletic", "athletics": "athletic", "pitch": "athletic",
    "tennis": "athletic", "basketball": "athletic", "football": "athletic", "baseball": "athletic", "park": "other", "building": "social",
}
EATING_CLUBS = ("Cap & Gown", "Charter", "Cloister", "Colonial", "Cottage", "Ivy", "Quadrangle", "Terrace", "Tiger", "Tower")


def content_end(products: tuple[str, ...] = POWERED_BY) -> str:
    """CONTENT_END for the given applications."""
    return CONTENT_END.format(products="|".join(map(re.escape, products)))


_WORD = "[A-Za-z0-9_]"
_START, _END = rf"(?<!{_WORD})(?={_WORD})", rf"(?<={_WORD})(?!{_WORD})"


def ascii_words(pattern: str, flags: str = "i") -> str:
    """The pattern for Spark, with ASCII word boundaries: the JVM's take all letters for parts of words.

    A boundary before letters is a word's start, any other its end, which is
    faster than either. Patterns whose words may begin with a mark need either.
    """
    either = "|@|" in pattern or r"|\[" in pattern
    bound = lambda m: f"(?:{_START}|{_END})" if either else _START if re.match(r"[A-Za-z0-9(]", pattern[m.end() :]) else _END
    return (f"(?{flags})" if flags else "") + re.sub(r"\\b", bound, pattern)
