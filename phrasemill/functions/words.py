"""Word lists, tags, limits and parameters that results must agree on."""

NOISE = ("hearing", "subcommittee", "committee", "congress", "session")
WEAK = (
    "things", "factors", "indicators", "regions", "aspects", "elements", "issues", "items", "matters", "topics", "areas", "units", "features",
    "conditions", "situations", "circumstances", "parameters", "variables", "data", "results", "outcomes", "findings", "processes", "procedures",
    "methods", "techniques", "approaches", "activities", "operations", "developments", "achievements", "productions", "perceptions",
)
JARGON = (
    "bibliographies", "bibliography", "monograph", "monographs", "proceedings", "dissertations", "yearbook", "yearbooks", "catalog", "catalogue",
    "catalogues", "catalogs", "supplements", "appendix", "appendices", "abstracts", "periodicals", "serials", "pamphlets", "leaflets", "lead ores",
    "defects", "specimens", "reagents",
)
ACTION_ENDINGS = ("ing", "tion", "sion", "ment", "ance", "ence", "ery", "ure", "al", "sis", "ry", "cy", "th", "se", "ge")
ACTIONS = (
    "rise", "fall", "fate", "birth", "death", "dawn", "age", "quest", "end", "loss", "cost", "role", "rule", "roots", "price", "cult", "myth", "dream",
    "ghost", "world", "life", "saga", "war", "art", "soul", "heart", "spirit", "genius", "secret", "mystery", "power", "future", "nature", "origins",
    "legacy", "promise", "triumph", "crisis", "limits", "paradox", "dilemma", "logic", "pursuit", "specter", "collapse", "plight", "impact", "source",
    "demise", "advent", "fabric", "drama", "gospel",
)
ITEM_TAGS = ("NOUN", "PROPN", "ADJ")
NOUN_TAGS = ("NOUN", "PROPN")
REJECTED_TAGS = ("DET", "CCONJ", "SCONJ", "VERB", "AUX", "PRON", "INTJ", "X")
LITERALS = (
    "and", "or", "the", "a", "an", "of", "in", "for", "to", "from", "with", "on", "at", "by", "as", "into", "through", "between", "about", "against",
    "across", "among", "beyond", "during",
)
LITERAL_PUNCTUATION = (",", ";", ":", "-", "--", "—")
ROMAN = ("I", "II", "III", "IV", "V")
TIERS = ("pop", "mainstream", "niche")
TAGS = ("funny", "grammar", "contradiction", "boring")
SLOTS = ("list_item", "action_noun", "of_object")
PART_SLOTS = ("of_modifier", "of_head", "of_topic", "of_complement")
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "en", "for", "if", "in", "of", "on", "or", "the", "to", "v", "v.", "via", "vs", "vs.")
SILENT_H = ("hour", "honest", "honor", "honour", "heir", "herb")
CONSONANT_SOUND = "^(uni([^nm]|$)|eu|one|once|ou[ij]|use|usu|ut[ei]|ure|ufo|u[kb]|ewe)"
PARAMS = (
    ("weighted_sample_spread", 0.4), ("weighted_sample_bias_floor", 0.05),
    ("tone_target_pop_list_item", 1.5), ("tone_target_pop_action_noun", 1.5), ("tone_target_pop_of_object", 1.0),
    ("tone_target_mainstream_list_item", 1.0), ("tone_target_mainstream_action_noun", 1.0), ("tone_target_mainstream_of_object", 0.8),
    ("tone_target_niche_list_item", 0.25), ("tone_target_niche_action_noun", 0.25), ("tone_target_niche_of_object", 0.25),
    ("sample_tone_spread", 0.6), ("tier_center_pop", 1.5), ("tier_center_mainstream", 0.75), ("tier_center_niche", 0.25),
    ("accessibility_threshold_pop", 1.0), ("accessibility_threshold_mainstream", 0.5),
    ("article_of_min_freq", 1.0), ("article_action_min_freq", 1.0), ("article_remix_heuristic_threshold", 0.6), ("remix_reject_double_of", 1.0),
    ("pop_weight_spl", 0.7), ("pop_weight_ol", 0.3), ("pop_weight_freq", 0.0), ("pop_exponent", 1.0), ("pop_base_weight_blend", 0.0),
    ("pop_tone_blend", 0.0), ("pop_missing_default", 0.1),
    ("pop_slot_mult_list_item", 1.0), ("pop_slot_mult_action_noun", 1.0), ("pop_slot_mult_of_object", 1.0),
)
#: word, tag, entity
LEXICON = tuple(
    [(w, "ADJ", "") for w in ("blue", "cold", "hot", "large", "new", "old", "red", "small", "secret")]
    + [(w, "NOUN", "") for w in ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget", "race", "power", "faith", "gender", "home", "money", "life")]
    + [(w, "PROPN", "GPE") for w in ("africa", "america", "asia", "europe", "u.s.")]
    + [(w, "DET", "") for w in ("a", "an", "the", "this", "that")]
    + [(w, "ADP", "") for w in ("of", "in", "for", "to", "from", "with", "on", "at", "by", "as", "into", "through", "between", "about", "against", "across", "among", "beyond", "during")]
    + [(w, "CCONJ", "") for w in ("and", "or", "but")]
    + [(w, "PRON", "") for w in ("it", "he", "she", "they", "i", "you", "we")]
    + [(w, "AUX", "") for w in ("is", "was", "are", "be", "been")]
)
