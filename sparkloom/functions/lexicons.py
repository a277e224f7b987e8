"""Word lists and patterns of the discourse rules. All are fixed values: results depend on them literally."""

from __future__ import annotations

# Property terms that suffice as evidence on their own.
DOMAIN_TERMS = [
    "apartment", "apartments", "arabian ranches", "asking price", "azizi", "aldar", "al furjan", "binghatti", "business bay",
    "capital appreciation", "commercial property", "construction", "creek harbour", "damac", "damac hills", "danube", "developer",
    "developers", "dewa", "discovery gardens", "dld", "down payment", "downtown dubai", "dubai creek harbour", "dubai hills",
    "dubai investment park", "dubai land department", "dubai marina", "dubai properties", "dubai silicon oasis", "dubai south",
    "dubai sports city", "ejari", "ellington", "emaar", "eviction", "flat", "flats", "flipping", "freehold", "handover", "home loan",
    "house prices", "house purchase", "housing", "housing affordability", "housing prices", "international city",
    "investment property", "jlt", "jumeirah lake towers", "jumeirah village circle", "jvc", "landlord", "landlords", "lease",
    "leasehold", "leasing", "listing", "listings", "maid room", "maintenance fee", "mansion", "market value", "meraas", "mirdif",
    "mortgage", "motor city", "nakheel", "off plan", "off-plan", "offplan", "omniyat", "oqood", "palm jumeirah", "payment plan",
    "penthouse", "penthouses", "plot", "price per sqft", "properties", "property", "property agent", "property broker",
    "property developer", "property investment", "property management", "property prices", "property purchase", "real estate",
    "real estate agent", "real estate agents", "real estate broker", "rent", "rent increase", "rental", "rental contract",
    "rental increase", "rental yield", "renter", "renters", "renting", "renting out", "rents", "reportage", "rera", "residential",
    "roi", "security deposit", "service charge", "silicon oasis", "sobha", "speculation", "sq ft", "sqft", "square foot", "tenancy",
    "tenancy contract", "tenant", "tenants", "the greens", "the meadows", "the springs", "title deed", "town square", "townhouse",
    "townhouses", "transaction", "transactions", "under construction", "verdana", "villa", "villas", "yield",
]
CONTACT = ["whatsapp", "call now", "contact us", "contact me", "contact for", "dm me", "dm for", "dm details", "send me a dm", "pm me", "book viewing", "schedule a viewing", "book your unit", "register your interest", "link in bio"]
LISTING = ["for sale", "for rent", "selling my", "available now", "ready to move", "limited offer", "exclusive offer", "starting at", "motivated seller", "distress deal", "below original price", "below op", "dld waiver", "rera permit", "permit no", "reference no"]
REACTION = ["thanks", "thank you", "thx", "lol", "lmao", "bump", "following"]
SPEC = r"\b(?:aed|sq\s*ft|sqft|[1-9]\s*(?:br|b/r)|fully furnished|payment plan|brand new|vacant)\b"
SOLICIT = r"\b(?:i(?: am|'m)?|we(?: are|'re)?|my|our)\b.{0,55}\b(?:offer|offering|selling|leasing|listing|inventory|broker|agent)\b"
CONTACT_ONLY = r"(?:(?:hi|hello|hey|please|pls|kindly|just|i|you|your|a|me|my|have|the|in|for|and|sent|send|check|checked|message|messaged|dm|dmed|pm|inbox|private|chat|connect|connected|details|interested|thanks|thank|already|you)\W*){1,14}"
DELETED = r"^\s*\[(?:deleted|removed)\]\s*$"
NON_LATIN = "[؀-ۿऀ-ॿ一-鿿]"
BOT_NAME = r"bot|auto|crawler|scraper|spam"
URL, MENTION, HASHTAG = r"https?://\S+|www\.\S+", r"@\w+", r"#(\w+)"

# Substring cues of the listing filters.
NOISE_CUES = ["crypto", "bitcoin", "ethereum", "nft", "airdrop", "token", "giveaway", "promo code", "coupon", "job", "jobs", "hiring", "vacancy", "apply now", "career", "salary", "recruitment", "biggboss", "bb19", "tanyamittal", "farrhana", "gauravkhanna", "celebrity", "bollywood", "restaurant", "food delivery", "hotel booking", "flight ticket", "tourist visa", "forex signal", "trading signal", "casino", "betting"]
AGENT_LISTING_CUES = ["whatsapp", "call now", "contact us", "dm me", "dm for", "inbox", "book now", "book your unit", "book viewing", "schedule a viewing", "viewing", "register now", "limited offer", "exclusive offer", "for sale", "for rent", "available now", "ready to move", "fully furnished", "brand new", "vacant", "single row", "motivated seller", "distress deal", "distressed property", "below op", "below original price", "payment plan", "handover soon", "dld waiver", "commission", "broker", "agent", "rera permit", "permit no", "ref no", "reference no", "roi", "guaranteed return", "starting at", "aed", "sqft", "sq ft", "1br", "2br", "3br", "4br", "5br"]
LOW_INFO_EXACT = ["yes", "yeah", "yep", "no", "nope", "ok", "okay", "thanks", "thank you", "thx", "sure", "done", "lol", "lmao", "this", "same", "agreed", "true", "very true", "exactly", "following", "bump", "price", "details", "details please", "share details", "send details", "interested", "dm", "dm me", "please dm", "pls dm", "dm please", "dm sent", "sent dm", "sent a dm", "check dm", "check your dm", "please check your dm", "kindly check your dm", "inbox", "pm me", "private chat", "pls connect", "please connect", "connect", "hi pls connect", "hi please connect"]
MODERATOR_NOTICE = r"your post has been removed because it does not|your comment has been removed because it does not|removed by moderator|this post was removed|this comment was removed"
CONTACT_NOISE = r"check your dm|check dm|dm sent|sent dm|sent a dm|please dm|pls dm|dm please|kindly check your dm|private chat|pls connect|please connect|inbox|pm me"
EXTRA_LOW_INFO_EXACT = ["sent", "dm d you", "dmed you", "dm pls", "dm you", "please share", "just sent you a message", "hey man let s talk"]
EXTRA_CONTACT = r"\bdm\s*d you\b|\bdmed you\b|\bdm pls\b|\bdm you\b|\bjust sent you\b|\bsent you in dm\b|\bsent you a dm\b|\bsent you a message\b|\bprofile bio\b|\bavailable in my bio\b|\bmessage me\b|\bping me\b|\blet s talk\b|\blet us talk\b"
CONTACT_LINES = [r"d+\.?m+\.?", "dm me", r"dm\s+details", "send me (a )?dm", "sent (a )?dm", "sent you (a )?dm", "i sent you (a )?dm", "i just sent you.*private chat", "private chat", "inbox", "pm me", "pls connect", "please connect", r"hi\.?\s*pls connect", r"hi\.?\s*please connect", "connect", "interested", r"interested\.?\s*looking for myself\.?", "details", "share details", "send details"]
SHORT_CONTACT_WORDS = r"\b(dm|inbox|connect|details|private chat|pm)\b"

# The explicit-offer classifier's patterns.
OFFER_DIRECT = r"\b(?:dm|pm|contact|message|whatsapp|reach out)\s+(?:me|us)\b"
OFFER_SERVICE = r"\b(?:consultation|viewing|options|details|available|availability|assist|help you|portfolio|show you|interested|looking|seeking)\b"
OFFER_DIRECT_NOT = r"^(?:is (?:this|it)|still available|any\b)|\b(?:do not|don.t)\s+(?:dm|contact|message)"
OFFER_DIRECT_OWN = r"\b(?:consultation|show you|help you|i have|we have|our|available|availability|portfolio)\b"
OFFER_BROKER, OFFER_BROKER_OWN = r"^\W*broker here\b", r"\b(?:i have|we have|got other|we can discuss)\b"
OFFER_WORDS = r"\b(?:for sale|for rent|available for|asking price|selling price|motivated seller|direct (?:from|with) (?:the )?owner)\b"
OFFER_SPECS = [
    r"\b\d+\s*(?:br|bhk|bed(?:room)?s?)\b",
    r"\b(?:aed|dhs?|dirhams?)\s*[\d,.]+|\b\d+(?:\.\d+)?\s*[mk]\b",
    r"\b(?:sq\.?\s*ft|sqft|square feet|bua|built.up area|plot area)\b",
    r"\b(?:fully furnished|semi.furnished|vacant on transfer|vaccant on transfer|private pool|payment plan|handover in)\b",
]
OFFER_REQUEST = r"\b(?:looking for|looking to (?:buy|purchase)|planning to (?:buy|purchase)|seeking|wanted|want to buy|i bought|i purchased|i found|we bought|where (?:can|do)|anyone (?:have|know)|recommend|need advice|should i|is it|what do you|can anyone)\b"
OFFER_HEADER = r"\b(?:for sale|for rent|available|asking price|selling price|motivated seller)\b"
OFFER_SALES = r"\b(?:urgent sale|distress sale|serious buyers only|direct clients preferred|lowest in (?:the )?market|high.yield investment opportunity)\b"
OFFER_PHONE = r"\b(?:connect|contact|call|whatsapp|reach)\s+(?:(?:me|us)\s+)?(?:on|at)?\s*\+?\d[\d\s().-]{7,}\d"
OFFER_OPENING = 220

# The triage router's signals.
TRIAGE_PROPERTY = r"\b(?:real estate|propert(?:y|ies)|apartment(?:s)?|villa(?:s)?|townhouse(?:s)?|landlord(?:s)?|tenant(?:s)?|tenancy|ejari|rera|mortgage(?:s)?|rental(?:s)?|rent(?:s|ing|ed)?|off[ -]?plan|lease(?:s|hold)?|freehold|escrow|title deed|service charges?|security deposit|handover|housing|home prices?|house prices?|eviction|evict(?:ed|ing)?|dld|rental dispute|conveyanc(?:ing|er))\b"
TRIAGE_GEO = r"\b(?:dubai|uae|abu dhabi|sharjah|ajman|jvc|jvt|jlt|jbr|jumeirah|meydan|arjan|emaar|damac|sobha|nakheel|azizi|binghatti|deira|barsha|al furjan|business bay|dubai south|dubai hills|international city|dubai marina|palm jumeirah)\b"
TRIAGE_HOUSING = r"\b(?:apartment|villa|townhouse|landlord|tenant|tenancy|ejari|rera|mortgage|off[ -]?plan|leasehold|freehold|title deed|housing|dld|eviction)\b"
TRIAGE_CONTACT = r"\bdm\b|whatsapp|contact me|message me|call me|check (?:your )?inbox"
TRIAGE_OFFER = r"\b(?:for sale|for rent|selling price|asking price|unit details|exclusive listing|distress deals?|i have (?:a |an |one |[0-9])|i can offer|book (?:a |your )?viewing|payment plan|limited units|investment opportunity|start your .*investment journey)\b"
TRIAGE_MARKETING = r"\b(?:check out my latest|i just published|our clients|our latest|contact us|book now|register now|dm me for|for more details dm|experience the|introducing our|start your .*investment journey)\b"
TRIAGE_FEATURES = r"\b(?:bedrooms?|bathrooms?|bua|sq\.?\s*ft|sqft|plot|payment plan|selling price|asking price|property details|unit details)\b"
TRIAGE_PRICE = r"\b(?:price|aed|[0-9]+\.?[0-9]*m)\b"
TRIAGE_POLITICS = r"\b(?:war|missile|drone|iran|israel|conflict|bomb|attack|ceasefire|geopolitic\w*)\b"
TRIAGE_VEHICLE = r"car rental|rent(?:ing)? (?:a |the )?car|rental car|private jet|rent.free (?:in|inside)"
TRIAGE_BOT_NAME, TRIAGE_BOT_NOTICE = r"^(?:automoderator|autotldr)$", "i am a bot, and this action was performed automatically"
STRATUM_PROPERTY = r"\b(?:real estate|propert(?:y|ies)|apartment\w*|villa\w*|townhouse\w*|landlord\w*|tenant\w*|tenancy|ejari|rera|mortgage\w*|rent(?:al|s|ing|ed)?|off[ -]?plan|lease\w*|escrow|title deed|housing|evict\w*|handover|dld|service charges?)\b"
STRATUM_CONTACT = r"\b(?:dm|pm|whatsapp|telegram|inbox|contact me|send (?:me )?details|share (?:the )?details)\b"

# Cues of the second and third listing rules, promotion, specification and analysis in turn.
STRONG_LISTING_2 = [
    "whatsapp", "call now", "contact us", "contact me", "dm me", "dm for", "send me a dm", "inbox", "book viewing", "schedule a viewing", "viewing today", "register now", "dm to register",
    "limited offer", "exclusive offer", "available now", "ready to move", "for sale", "for rent", "rent with", "selling my", "selling 1br", "selling 2br", "selling 3br", "motivated seller",
    "distress deal", "distressed property", "below op", "below original price", "dld waiver", "commission", "broker", "agent", "rera permit", "permit no", "ref no", "reference no",
    "guaranteed return", "book your unit",
]
STRONG_LISTING_3 = [
    "whatsapp", "call now", "contact us", "contact me", "contact for", "dm me", "dm for", "dm details", "send me a dm", "sent a dm", "sent you a dm", "sent you in private chat", "private chat",
    "pm me", "inbox", "pls connect", "please connect", "connect with me", "book viewing", "schedule a viewing", "viewing today", "register now", "dm to register", "available now",
    "ready to move", "for sale", "for rent", "selling my", "motivated seller", "distress deal", "distressed property", "below op", "below original price", "dld waiver", "commission", "broker",
    "agent", "rera permit", "permit no", "ref no", "reference no", "guaranteed return", "book your unit", "limited offer", "exclusive offer",
]
WEAK_LISTING = ["aed", "sqft", "sq ft", "1br", "2br", "3br", "4br", "5br", "studio", "fully furnished", "brand new", "vacant", "single row", "payment plan", "handover soon", "starting at", "roi"]
ANALYSIS_2 = [
    "analysis", "market", "price drop", "prices", "rent prices", "transaction", "transactions", "recorded", "data", "report", "index", "bubble", "panic", "collapsed", "overvalued", "undervalued",
    "demand", "supply", "trend", "investors who bought", "everyone panicking", "looked at", "scanned",
]
ANALYSIS_3 = [
    "analysis", "market", "price drop", "prices", "rent prices", "transaction", "transactions", "recorded", "data", "report", "index", "bubble", "panic", "collapsed", "overvalued", "undervalued",
    "demand", "supply", "trend", "investors who bought", "everyone panicking", "scanned", "forecast", "valuation",
]

#: Words that mark a text as English where nothing says its language.
ENGLISH_WORDS = ["the", "and", "of", "to", "in", "is", "it", "that", "for", "was", "on", "are", "with", "this", "you", "be", "at", "have", "not", "or"]
