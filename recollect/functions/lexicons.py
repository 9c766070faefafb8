"""Word lists that the scores and classifiers test for, as substrings of lower-cased text."""

# Fixed values.
HIGH_EMOTION = ["amazing", "excellent", "fantastic", "love", "excited", "happy", "thrilled", "great", "awesome", "wonderful", "perfect", "terrible", "awful", "hate", "frustrated", "angry", "annoyed", "disappointed", "failed", "error", "bug", "broken", "crash", "urgent", "critical", "important", "asap", "emergency", "deadline"]
MEDIUM_EMOTION = ["good", "bad", "nice", "issue", "problem", "fixed", "solved", "like", "dislike", "prefer", "better", "worse", "concern"]
ERROR_WORDS = ["error", "exception", "failed", "crash", "bug", "traceback", "stack trace", "not working"]
CODE_MARKS = ["```", "def ", "class ", "import ", "function ", "const ", "let ", "var ", "=>", "->"]
DECISION_WORDS = ["decided", "choose", "chose", "will use", "going with", "selected", "picked", "opted for"]
PREFERENCE_WORDS = ["prefer", "like", "love", "hate", "dislike", "favorite", "best", "worst", "rather", "instead"]
FIRST_PERSON = ["i am", "i'm", "my ", "i have", "i've", "i like", "i love", "i went", "i saw", "i did"]
EMPHATIC = ["always", "never", "favorite", "allergic", "hate"]
TIME_WORDS = ["years", "months", "ago", "since", "started", "yesterday", "tomorrow", "last", "next"]
STOP_PHRASES = ["hello", "hi", "hey", "bye", "goodbye", "thanks", "thank you", "okay", "ok", "yes", "no", "sure", "hmm", "um", "uh"]
TOPICS = {
    "personal_info": ["name", "age", "birthday", "born", "identity", "i am", "i'm"],
    "preferences": ["like", "love", "hate", "prefer", "favorite", "enjoy", "dislike"],
    "relationships": ["friend", "family", "married", "spouse", "partner", "colleague", "mother", "father", "sister", "brother", "wife", "husband"],
    "events": ["went", "visited", "attended", "happened", "meeting", "party", "conference", "trip", "vacation"],
    "locations": ["live", "moved", "city", "country", "address", "location", "from", "to", "place"],
    "work": ["work", "job", "company", "office", "career", "profession", "salary", "project", "team"],
    "health": ["health", "sick", "doctor", "hospital", "medicine", "allergy", "diet", "exercise", "vegetarian", "vegan"],
    "hobbies": ["hobby", "sport", "game", "music", "art", "reading", "cooking", "hiking", "photography"],
    "temporal": ["year", "month", "day", "ago", "since", "duration", "how long", "when", "started", "ended"],
}
