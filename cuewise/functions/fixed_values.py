"""Fixed values. Word lists and constants that results depend on, stated as plain text."""

# Words that never open a clip.
HOOK_FILLERS = "um uh umm uhh hmm mm mhm er ah eh".split()

# Words removed by punchy tightening.
TIGHTEN_FILLERS = "um uh umm uhh hmm er ah mm mhm".split()

# Words too common to steer a topic focus.
FOCUS_STOP = (
    "a an the and or of on in to for with about my our your how what why when is are was it its "
    "this that stuff things thing talk talking part parts moment moments clip clips"
).split()

# Suffixes stripped from focus terms, first match wins.
FOCUS_SUFFIXES = "ing ers er ed es s".split()

# Words highlighted wherever they stand.
POWER_WORDS = (
    "free secret never always new best stop money win wins viral insane crazy easy fast proven "
    "truth lies lie mistake mistakes hack million billion first last warning exposed rich "
    "guaranteed subscribe subscribed challenge challenges world"
).split()

# Words that never become a hashtag.
TAG_STOP = (
    "the and that this with from have were they them then than what when where which while would "
    "could should your youre about into over after before because just like know think mean "
    "really very much more most some such only also even still back here there theyre were been "
    "being does doing dont cant wont isnt arent wasnt werent hasnt havent didnt doesnt"
).split()

# Headline rules: openers to drop, openers and tails that disqualify, question openers, tag tails.
FILLER_OPEN = (
    "so and but like um uh uhm okay ok well yeah yes right now look listen honestly basically "
    "actually anyway oh hey"
).split()
DANGLING_OPEN = (
    "it it's its that that's he she they him her them which because or then also too than"
).split()
QUESTION_OPEN = (
    "what why how who when where which is are was were do does did can could would should will "
    "have has am whats what's who's how's where's isn't aren't don't doesn't didn't can't won't "
    "wouldn't shouldn't"
).split()
TAG_TAIL = "right okay ok yeah huh no correct yes".split()
DANGLING_TAIL = "a an the and or but because my your our their had been being".split()
HEADLINE_FILLERS = "um uh uhm mm hmm".split()

# Words a shortened headline may not end on.
DANGLING = (
    "a an the and or but so to of in on at for with from by as is are was were be that this my "
    "your our their his her its if when than then because about into i you we they he she it not "
    "just very really like all"
).split()

# Caption styles; picks default to the second, captions to the first.
STYLES = "tiktok karaoke hormozi minimal beast neon highlight ghost".split()

# Media file extensions.
MEDIA_EXT = "mp4 mov mkv webm m4v avi m4a mp3 wav".split()

# Language code and name.
LANGUAGES = [
    ("en", "English"), ("sq", "Albanian"), ("de", "German"), ("fr", "French"),
    ("es", "Spanish"), ("it", "Italian"), ("tr", "Turkish"), ("pt", "Portuguese"),
    ("nl", "Dutch"), ("pl", "Polish"), ("ro", "Romanian"), ("el", "Greek"),
    ("sr", "Serbian"), ("hr", "Croatian"), ("bs", "Bosnian"), ("mk", "Macedonian"),
    ("sv", "Swedish"), ("ru", "Russian"), ("uk", "Ukrainian"), ("ar", "Arabic"),
    ("hi", "Hindi"), ("ja", "Japanese"), ("ko", "Korean"), ("zh", "Chinese (Simplified)"),
]

# Broadcast frame rates (numerator, denominator).
FRAME_RATES = [
    (24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (50, 1), (60000, 1001), (60, 1),
]

# Output canvases: aspect, width, height.
CANVASES = [("9:16", 1080, 1920), ("4:5", 1080, 1350), ("1:1", 1080, 1080), ("16:9", 1920, 1080)]

# Merit bar of automatic picking.
AUTO_KEEP_SCORE = 62.0
# Most candidates judged per run.
JUDGE_MAX = 24
