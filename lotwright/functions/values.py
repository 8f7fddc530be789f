"""Word lists, patterns and rates that decide what listings mean. Patterns are for lower-cased plain text unless they say otherwise."""

# ---- Fixed values: product identity

#: Words that say nothing about a product.
NOISE = "retail new brand the best with and for built in a of to up included includes free shipping lot item items qty x pack set estimated est price msrp value approx approximately assorted various".split()
#: Further words that say nothing when titles are compared.
RETAIL_NOISE = NOISE + "adult adults black blue clear green grey gray kids large medium pink purple red small white wooden".split()
#: Words left out of search phrases.
QUERY_NOISE = "nice estate untested working approx approximate damage damaged read look wow rare".split()
#: Tokens shaped like models; the second form in titles, the third where a model is stated.
MODEL = r"^[A-Za-z]{1,8}-?\d{1,8}[A-Za-z0-9+.-]*$"
TITLE_MODEL = r"^(?=[A-Z0-9+.-]*[A-Z]{2})[A-Z0-9]{1,8}-[A-Z0-9+.]{2,14}$"
STATED_MODEL = r"^[A-Za-z]{1,8}-[A-Za-z0-9+.]{2,14}$"
GENERIC_MODEL = (
    r"(?i)^(?:n/?a|none|null|nil|unknown|unspecified|various|assorted|misc(?:ellaneous)?|standard|generic|regular|default|see\s+(?:photos?|pictures?|description)|no\s+model|model|[a-z]\s*-?\s*series|series|multiple"
    r"|ddr[345](?:l|x)?|wi[\s-]*fi\s*[5-7]e?|bluetooth\s*\d+(?:\.\d+)?|bt\s*\d+(?:\.\d+)?|usb\s*\d+(?:\.\d+)?|hdmi\s*\d+(?:\.\d+)?)$"
)
GENERIC_BRAND = (
    r"(?i)^(?:wireless|smart|portable|professional|digital|electric|electronic|gaming|bluetooth|usb|4k|8k|hd|full|mini|new|vintage|built[\s-]?in|multifunction|automatic|cordless|rechargeable|custom|workstation|tower"
    r"|desktop|computer|system|inch|external|drive|console|receiver|headset|headphones?|monitor|television|tv|camera|printer|speaker|router|vacuum|couch|crystal|pink|beach|tandem|heated|wooden|steam|solar|royal|black"
    r"|white|clear|low|compact|dried|calming|extra|girls|baby|hallway|mold|linen|cat|king|prone|creativity|countertop)$"
)
CAPACITY = r"(?i)^(?:\d+(?:\.\d+)?\s*[xX]\s*)?\d+(?:\.\d+)?(?:gb|tb|mb|kb)$"
#: Kinds of goods in the order in which they are tried.
KINDS = {
    "game-console": r"\b(?:(?:playstation\s*[2-6]|ps\s*[2-6]|xbox(?:\s+(?:one|series\s*[sx]))?|nintendo\s+switch)[^,;]{0,35}\b(?:consoles?|systems?)|game\s+consoles?)\b",
    "graphics-card": r"\b(?:graphics|video)\s+cards?\b|\b(?:geforce\s+)?rtx\s*\d{3,4}\b|\bradeon\s+rx\s*\d{3,4}\b",
    "memory": r"\b(?:ram|memory\s+(?:kits?|modules?)|ddr[345])\b",
    "processor": r"\b(?:cpus?|processors?|core\s+i[3579][\s-]*\d{4,5}[a-z]*|ryzen\s+[3579]\s+\d{4}[a-z]*)\b",
    "smartwatch": r"\b(?:smart\s*watches?|apple\s+watch|galaxy\s+watch|pixel\s+watch)\b",
    "power-tool": r"\b(?:impact\s+drivers?|hammer\s+drills?|cordless\s+drills?|circular\s+saws?|reciprocating\s+saws?|angle\s+grinders?|nail\s+guns?)\b",
    "storage": r"\b(?:external|portable)\s+(?:hard\s+)?drives?\b|\b(?:hard\s+drives?|ssds?|hdds?)\b",
    "projector": r"\bprojectors?\b",
    "monitor": r"\b(?:computer\s+)?monitors?\b",
    "television": r"\b(?:televisions?|tvs?|qled|oled)\b",
    "receiver": r"\b(?:a/?v\s+)?receivers?\b|\bamplifiers?\b",
    "headphones": r"\b(?:headphones?|headsets?|earbuds?|earphones?)\b",
    "microphone": r"\b(?:microphones?|mics?)\b",
    "laptop": r"\b(?:laptops?|notebooks?|macbooks?|chromebooks?)\b",
    "desktop": r"\b(?:desktop(?:\s+computers?)?|all[\s-]in[\s-]ones?|computer\s+towers?|gaming\s+pcs?)\b",
    "tablet": r"\b(?:tablets?|ipads?)\b",
    "phone": r"\b(?:smartphones?|cell\s+phones?|iphones?|phones?)\b",
    "speaker": r"\b(?:speakers?|soundbars?)\b",
    "camera": r"\b(?:cameras?|camcorders?)\b",
    "printer": r"\b(?:printers?|scanners?)\b",
    "keyboard": r"\bkeyboards?\b",
    "mouse": r"\b(?:computer\s+)?mice\b|\bmouse\b",
    "router": r"\b(?:routers?|mesh\s+systems?)\b",
    "vacuum": r"\b(?:vacuum(?:\s+cleaners?)?|robot\s+vacuums?)\b",
    "car-stereo": r"\b(?:car\s+stereos?|carplay\s+(?:stereos?|radios?)|head\s+units?)\b",
}
#: Families of goods.
FAMILIES = {
    "snorkel-mask": r"\b(?:snorkel(?:ing)?\s+(?:gear\s+)?(?:set\s+)?[^,;]{0,25}mask|diving\s+mask)\b",
    "anti-fog-spray": r"\b(?:anti[\s-]*fog\s+spray|defogger)\b",
    "kickball": r"\b(?:kickball|mega\s+ball)\b",
    "football": r"\bfootballs?\b",
    "soccer-ball": r"\bsoccer\s+balls?\b",
    "bounce-ball": r"\b(?:bounce|bouncy)\s+ball\b",
    "pasta-bowls": r"\bpasta\s+bowls?\b",
    "dinnerware-set": r"\b(?:dinnerware|dishware|plates?\s+and\s+bowls?)\b",
    "neck-fan": r"\bneck\s+fans?\b",
    "handheld-fan": r"\b(?:handheld|turbo)\s+fans?\b",
    "steam-cleaner": r"\b(?:steam\s+cleaners?|handheld\s+steamers?)\b",
    "cleaning-cloth": r"\b(?:microfiber\s+cloths?|steam\s+cleaner\s+pads?)\b",
    "irrigation-system": r"\b(?:drip\s+irrigation\s+(?:kit|system)|irrigation\s+timer)\b",
    "replacement-parts": r"\b(?:replacement\s+(?:parts?|kit)|parts?\s+only)\b",
    "vase": r"\bvases?\b",
    "planter": r"\b(?:planters?|flower\s+pots?)\b",
}
#: Families that exclude each other: a candidate of another member is another product.
EXCLUSIVE = [
    ["kickball", "football", "soccer-ball", "bounce-ball", "other-ball"],
    ["vase", "planter"],
    ["pasta-bowls", "dinnerware-set"],
    ["neck-fan", "handheld-fan"],
    ["steam-cleaner", "cleaning-cloth"],
    ["irrigation-system", "replacement-parts"],
]
COLORS = "black white red blue green purple pink grey gray beige brown orange yellow clear ivory burgundy flaxen wheat".split()
MATERIALS = {
    "sherpa": r"\bsherpa\b", "fleece": r"\bfleece\b", "cotton": r"\bcotton\b", "linen": r"\blinen\b", "velvet": r"\bvelvet\b",
    "leather": r"\bleather\b", "stainless-steel": r"\bstainless\s+steel\b", "plastic": r"\bplastic\b", "glass": r"\bglass\b",
    "ceramic": r"\bceramic\b", "wood": r"\b(?:wood|wooden)\b", "nylon": r"\bnylon\b", "polyester": r"\bpolyester\b",
    "microfiber": r"\bmicrofiber\b", "rubber": r"\brubber\b",
}
#: Brands under several names.
BRANDS = {
    "sony": r"\b(?:sony|playstation)\b",
    "microsoft": r"\b(?:microsoft|xbox)\b",
    "apple": r"\b(?:apple|iphone|ipad|macbook|airpods)\b",
    "google": r"\b(?:google|pixel)\b",
    "meta": r"\b(?:meta|oculus)\b",
    "western-digital": r"\b(?:western\s+digital|wd)\b",
    "hewlett-packard": r"\b(?:hewlett[\s-]+packard|hp)\b",
}
#: Names of series, words that tell their members apart, and units that make a number no member.
SERIES = "iphone ipad pixel galaxy quest airpods macbook surface echo kindle roomba dyson gopro".split()
VARIANTS = "pro max plus ultra mini air lite slim fold flip generation gen".split()
UNIT_WORDS = "inch inches gb tb mb kb hz mhz ghz w watts".split()
VOLUMES = {"oz": r"fl\s*oz|oz|ounces?", "qt": r"qt|quarts?", "ml": "ml", "l": r"liters?|litres?|l", "cup": "cups?"}
#: Nouns of parts and accessories, and phrases that say what they are for.
ACCESSORY = (
    r"\b(case|cover|sleeve|skin|pouch|protector|tips|eartips|cable|charger|adapter|mount|holder|stand|arm|topper|strap|band|bumper|shell|film|dock|lanyard|clip|controller|game|spray|cloth|cloths|pads?|wipes?|filters?|valves?"
    r"|sensor\s*wires?|disc\s+drive|baffle|shield|backplate|back\s*plate|faceplate|bracket|standoffs?|screws?|screw\s*kit|thermal\s*pad|riser|extender|gasket|grommet|spacer|shroud|bezel|decal|sticker|manual|module|chip|header"
    r"|jumper|ribbon|harness|insert)s?\b"
)
MARKER = r"\b(compatible\s+with|replacement\s+for|replacement\s+parts?\s+only|designed\s+for|made\s+for|for\s+use\s+with|fits\s+(?:the\s+)?[a-z0-9])"
FOR_VERBS = r"compatible\s+with|replacement\s+(?:part\s+)?for|designed\s+for|made\s+for|for\s+use\s+with|fits|suitable\s+for|upgrade\s+for"
LATER_MARKER = r"\b(?:for|compatible\s+with|replacement\s+for|designed\s+for|made\s+for|fits)\b"
NOT_WHOLE = r"\breplacement\s+parts?\s+only\b|\bnot\s+a\s+complete\b"
TITLE_PREFIX = r"^\s*(?:\(?\s*(?:open\s*box|openbox|refurbished|refurb|renewed|used|pre[\s-]?owned)[^-|:]*\)?\s*[-|:]\s*)+"
USED = r"\b(open\s*box|openbox|refurbished|refurb|renewed|pre[\s-]?owned|used|for\s+parts)\b"
#: What stands before a title proper, in the order in which it is taken away.
PREFIXES = [
    r"^\s*lot\s*#?\s*[a-z0-9-]+\s*[-:|]\s*",
    r"^\s*(?:av|inv(?:entory)?|sku|stock|item)\s*(?:#\s*[a-z0-9-]+\s*)?[-:|]\s*",
    r"^\s*(?:brand\s+new|new|open\s*box|used|refurbished|renewed)\s*[-:|]\s*",
]

# ---- Fixed values: condition

PARTS = r"\b(for\s*parts|parts\s*only|salvage|broken|not\s*working|non[\s-]*functional|defective|scrap|damaged\s*beyond)\b"
GOOD = r"\b(brand\s*new|new|sealed|excellent|like\s*new|mint|open\s*box|good|very\s*good)\b"
POSITIVE = r"\b(tested\s*(?:and\s*)?working|works?\s*(?:great|well|fine|perfectly)|fully\s*functional|brand\s*new|sealed|new\s*in\s*box|nib\b)"
PARTS_REASONS = {
    "listed for parts only": r"\bfor\s*parts\s*(?:only)?\b",
    "parts only": r"\bparts\s*(?:only|/\s*repair)\b",
    "stated not working": r"\bnot\s*working\b",
    "does not work / power on": r"\bdoes\s*not\s*(?:work|turn on|power)",
    "non-functional": r"\bnon[\s-]*functional\b",
    "described as broken": r"\bbroken\b",
    "shattered": r"\bshattered\b",
    "cracked": r"\bcracked\b",
    "salvage": r"\bsalvage\b",
    "defective": r"\bdefective\b",
    "damaged": r"\bdamaged\b",
    "for repair": r"\bfor\s*repair\b",
    "as-is, no returns": r"\bas[\s-]*is[\s,]*no\s*returns?\b",
    "incomplete": r"\bincomplete\b",
    "missing parts": r"\bmissing\s*(?:parts|pieces|components)\b",
}
CAUTIONS = {
    "untested": r"\buntested\b",
    "not tested": r"\bnot\s*tested\b",
    "open box": r"\bopen\s*box\b",
    "customer return": r"\breturn(?:ed|s)?\b",
    "scratched": r"\bscratch(?:ed|es)?\b",
    "dented": r"\bdent(?:ed|s)?\b",
    "refurbished": r"\brefurbish(?:ed)?\b",
    "used": r"\bused\b",
}
DAMAGE_TEXT = ["damage desct", "damage desc", "damage description", "damage details"]
MISSING_TEXT = ["missing parts desc", "missing parts description", "missing desc"]
DAMAGED = ["is item damaged", "item damaged", "damaged"]
MISSING = ["missing major parts", "missing parts", "missing any parts"]
FUNCTIONAL = ["is item functional", "item functional", "functional", "working"]
UNSURE = r"^(?:n\s*/\s*a|n\.\s*a\.?|not\s*applicable|unknown|unspecified|unable|untested|not\s*tested|tbd|maybe|\?)"

# ---- Fixed values: retail prices, mixed lots, currency, description labels

RETAIL = [
    r"(?i)Est\.?\s*Retail\s*Price\s*:?\s*\$?\s*([\d,]+(?:\.\d{1,2})?)",
    r"(?i)\bRetail\s*(?:Price)?\s*:?\s*\$\s*([\d,]+(?:\.\d{1,2})?)",
    r"(?i)\bMSRP\s*:?\s*\$?\s*([\d,]+(?:\.\d{1,2})?)",
    r"^\s*\$\s*([\d,]+(?:\.\d{1,2})?)\s*(?:\||\s)",
]
#: (whether the title or the description is looked at, pattern, reason).
MIXED = [
    ("title", r"\b(?:group|assorted|various|mixed|collection|contents|equipment|rack|cabinet)\b", "group or mixed-lot wording"),
    ("title", r"\b(?:bundle|lot)\s+of\s+(?:different|assorted|mixed|various)\b", "mixed bundle wording"),
    ("title", r"\bwith\s+(?:components?|contents?|assorted\s+items?|mixed\s+items?|equipment)\b", "explicit component or contents wording"),
    ("description", r"\b(?:assorted|mixed|various)\s+(?:items?|components?|equipment|contents)\b", "description identifies assorted components"),
]
CAD = [r"(?i)\b(?:CAD|CDN)\b", r"(?:\$\s*)?\d[\d,.]*\s+Can\b"]
LABELS = ["Year", "Make", "Model", "VIN #", "Shelf Location", "Condition", "In Packaging?", "Assembly Required?", "Damaged?", "Functional?", "Missing Parts?"]

# ---- Fixed values: sales tax by state, in percent

STATE_TAX = {
    "AL": 9.46, "AK": 1.82, "AZ": 8.52, "AR": 9.46, "CA": 8.99, "CO": 7.89, "CT": 6.35, "DE": 0.0, "DC": 6.0, "FL": 6.98, "GA": 7.49, "HI": 4.5, "ID": 6.03,
    "IL": 8.96, "IN": 7.0, "IA": 6.94, "KS": 8.69, "KY": 6.0, "LA": 10.11, "ME": 5.5, "MD": 6.0, "MA": 6.25, "MI": 6.0, "MN": 8.14, "MS": 7.0, "MO": 8.69, "MT": 0.0,
    "NE": 6.95, "NV": 8.23, "NH": 0.0, "NJ": 6.6, "NM": 7.62, "NY": 8.53, "NC": 7.0, "ND": 7.04, "OH": 7.24, "OK": 8.99, "OR": 0.0, "PA": 6.34, "RI": 7.0, "SC": 7.49,
    "SD": 6.11, "TN": 9.55, "TX": 8.2, "UT": 7.19, "VT": 6.36, "VA": 5.77, "WA": 9.4, "WV": 6.57, "WI": 5.7, "WY": 5.44,
}
