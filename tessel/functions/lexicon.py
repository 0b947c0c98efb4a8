"""Word lists and relations of the matching rules.

Everything here is a fixed value: results are only right with these very words,
patterns and pairs.
"""

from __future__ import annotations

# --- fixed values: dosage-form words that normalisers delete ---
FORM_WORDS = r"\b(tabs?|tablets?|inj(ection)?s?|caps?(ules?)?|susp(ension)?|syp|syrup|drops?|cream|ointment|gel|liq(uid)?|sol(ution)?)\b"

# --- fixed values: dosage forms, in the order in which they are tried ---
FORMS: dict[str, list[str]] = {
    "injectable": "inj injection injections vial vials ampoule ampule amp amps iv im sc prefilled syringe infusion".split(),
    "solid_oral": "tab tabs tablet tablets caplet caplets cap caps capsule capsules softgel softgels chewable dispersible dt sr xr er cr mr xl la retard".split(),
    "liquid_oral": "syp syrup syrups susp suspension suspensions sol soln solution solutions oral elixir emulsion drops drop liquid liq".split() + ["oral drops", "paediatric drops", "ped drops"],
    "topical": "cream creams ointment ointments gel gels lotion lotions paste spray sprays foam powder topical crm oint".split() + ["dusting powder"],
    "eye_ear_nasal": "nasal ophthalmic otic eardrop eyedrop".split() + ["eye drop", "eye drops", "ear drop", "ear drops", "nasal drop", "nasal drops", "nasal spray"],
    "inhaler_respiratory": "inhaler inhalers rotacap rotacaps respule respules nebuliser nebulizer mdi dpi transcap autohaler inh inhalation inhalations".split(),
    "suppository_rectal": "suppository suppositories supp rectal enema".split(),
}
#: Form of a candidate that names none.
DEFAULT_FORM = "solid_oral"

# --- fixed values: pairs of forms that exclude each other ---
CLASHES: list[tuple[str, str]] = [
    ("solid_oral", "liquid_oral"), ("solid_oral", "injectable"), ("solid_oral", "topical"), ("solid_oral", "eye_ear_nasal"),
    ("solid_oral", "inhaler_respiratory"), ("solid_oral", "suppository_rectal"), ("liquid_oral", "injectable"),
    ("liquid_oral", "topical"), ("liquid_oral", "inhaler_respiratory"), ("injectable", "topical"),
    ("injectable", "eye_ear_nasal"), ("injectable", "inhaler_respiratory"), ("topical", "eye_ear_nasal"),
    ("topical", "inhaler_respiratory"), ("eye_ear_nasal", "inhaler_respiratory"),
]

# --- fixed values: company names ---
NO_COMPANY = ["", "--", "none", "null", "nan", "undefined", "unknown", "-"]
COMPANY_STOPWORDS = (
    "laboratories laboratory labs lab pharma pharmaceuticals pharmaceutical therapeutics healthcare lifesciences life sciences "
    "pvt ltd private limited india inc corp corporation co gmbh sa ag"
).split()
ACRONYM_STOPWORDS = COMPANY_STOPWORDS + ["and", "the", "of"]
#: Company texts that switch the company rule off, compared as written.
SKIP_COMPANY = ["", "--", "none", "null", "nan"]

# --- fixed values: suffixes of combination products ---
SUFFIXES = (
    "d dsr sr xr er cr mr xl la plus xt tz oz h at am lp sp ap force forte fort pd kid dc as sl dt ct rt mps df dx ds "
    "cv lb xp f e k2 gold mb hs aa pr od fb l ax snq dp th pg nt m beta tri ch ln t o av d3 p rapid"
).split()
OLD_SUFFIXES = [s for s in SUFFIXES if s not in ("p", "rapid")]

# --- fixed values: units and counts ---
UNIT_AND_FORM = (
    "tab tabs tablet tablets cap caps capsule capsules inj injection syp syrup susp suspension ml mg gm g mcg "
    "drop drops cream oint ointment gel lotion vial vials amp amps"
).split()
UNIT_SUFFIXES = "mg ml mcg gm g cap tab tabs caps".split()
PACK_COUNTS = [str(i) for i in range(1, 11)]
BROWSER_COUNTS = ["1", "2", "3", "4", "5", "6", "8", "10"]
COUNT_NOUNS = (
    "tab|tabs|tablet|tablets|cap|caps|capsule|capsules|vial|vials|amp|amps|ampoule|ampoules|sachet|sachets|pc|pcs|piece|pieces|"
    "strip|strips|pack|packs|packet|packets|bottle|bottles|bot|tube|tubes|pair|pairs|set|sets|roll|rolls|s"
)
#: Units of pack texts, the first pattern that is found counts; counts like "3 x 10 ml"; counts of a strip; any number.
PACK_UNITS = [
    ("ml", r"\bml\b"), ("gm", r"\bgm\b|\bgrams?\b"), ("cap", r"\b(caps?|capsules?)\b"), ("tab", r"\b(tabs?|tablets?)\b"), ("vial", r"\bvials?\b"),
    ("amp", r"\b(amps?|ampoules?)\b"), ("sachet", r"\bsachets?\b"), ("pc", r"\b(pc|pcs|pieces?)\b|\bps\b"), ("tab", r"\bstrips?\b"),
]
PACK_TIMES = r"(\d+)\s*[x*×]\s*(\d+(?:\.\d+)?)\s*(ml|gm|g\b)?"
PACK_STRIPS = [r"(\d+)\s*s\b", r"\bs\s*(\d+)"]
PACK_NUMBER = r"(\d+(?:\.\d+)?)"
PACK_WORDS = (
    "ml|gm|g|mg|tab|tabs|tablet|tablets|cap|caps|capsule|capsules|strip|strips|vial|vials|amp|amps|ampoule|ampoules|sachet|sachets|"
    "pc|pcs|piece|pieces|ps|bottle|tube|box|of|the|per|each"
)

# --- fixed values: brand aliases, one brand and what it may be called on each line ---
ALIASES: list[tuple[str, list[str]]] = [
    ("augmentin", ["amoxyclav", "amoxicillin clavulanate", "amox clav"]),
    ("amoxyclav", ["augmentin"]),
    ("moxclav", ["amoxyclav", "augmentin"]),
    ("clavam", ["amoxyclav", "augmentin"]),
    ("azithral", ["azithromycin", "azee", "zithromax"]),
    ("azee", ["azithromycin", "azithral"]),
    ("zithromax", ["azithromycin", "azithral", "azee"]),
    ("cifran", ["ciprofloxacin", "ciplox"]),
    ("ciplox", ["ciprofloxacin", "cifran"]),
    ("monocef", ["ceftriaxone", "cefaxone", "oframax"]),
    ("cefaxone", ["ceftriaxone", "monocef"]),
    ("taxim", ["cefotaxime"]),
    ("ceftas", ["ceftazidime"]),
    ("meronem", ["meropenem"]),
    ("levoflox", ["levofloxacin", "levoday", "levomac"]),
    ("levoday", ["levofloxacin", "levoflox"]),
    ("crocin", ["paracetamol", "dolo", "calpol", "pacimol", "tylenol"]),
    ("dolo", ["paracetamol", "crocin", "calpol"]),
    ("calpol", ["paracetamol", "crocin", "dolo"]),
    ("pacimol", ["paracetamol", "crocin", "dolo"]),
    ("combiflam", ["ibuprofen paracetamol", "brufen plus", "imol plus"]),
    ("brufen", ["ibuprofen", "ibugesic"]),
    ("ibugesic", ["ibuprofen", "brufen"]),
    ("voveran", ["diclofenac", "dynapar", "reactin"]),
    ("dynapar", ["diclofenac", "voveran"]),
    ("ultracet", ["tramadol paracetamol"]),
    ("flexon", ["ibuprofen paracetamol"]),
    ("pan", ["pantoprazole", "pantop", "pantocid"]),
    ("pantop", ["pantoprazole", "pan", "pantocid"]),
    ("pantocid", ["pantoprazole", "pan", "pantop"]),
    ("omez", ["omeprazole", "ocid"]),
    ("ocid", ["omeprazole", "omez"]),
    ("rablet", ["rabeprazole", "razo", "rabeloc"]),
    ("razo", ["rabeprazole", "rablet", "rabeloc"]),
    ("rabeloc", ["rabeprazole", "rablet", "razo"]),
    ("domperidone", ["domstal", "vomistop"]),
    ("domstal", ["domperidone", "vomistop"]),
    ("ondansetron", ["emeset", "ondem", "vomikind"]),
    ("emeset", ["ondansetron", "ondem"]),
    ("ondem", ["ondansetron", "emeset"]),
    ("pan d", ["pantoprazole domperidone", "pantocid d"]),
    ("pantocid d", ["pantoprazole domperidone", "pan d"]),
    ("rantac", ["ranitidine", "zinetac", "aciloc"]),
    ("zinetac", ["ranitidine", "rantac", "aciloc"]),
    ("ecosprin", ["aspirin", "disprin"]),
    ("disprin", ["aspirin", "ecosprin"]),
    ("atorva", ["atorvastatin", "lipitor", "tonact"]),
    ("tonact", ["atorvastatin", "atorva"]),
    ("telma", ["telmisartan", "telmikind", "telvas"]),
    ("telvas", ["telmisartan", "telma"]),
    ("amlong", ["amlodipine", "amlovas", "amlip"]),
    ("amlovas", ["amlodipine", "amlong"]),
    ("stamlo", ["amlodipine", "amlong"]),
    ("cardivas", ["carvedilol"]),
    ("metolar", ["metoprolol", "betaloc"]),
    ("betaloc", ["metoprolol", "metolar"]),
    ("concor", ["bisoprolol"]),
    ("clopitab", ["clopidogrel", "plavix", "clopilet"]),
    ("clopilet", ["clopidogrel", "clopitab", "plavix"]),
    ("plavix", ["clopidogrel", "clopitab", "clopilet"]),
    ("enoxarin", ["enoxaparin", "clexane"]),
    ("clexane", ["enoxaparin", "enoxarin"]),
    ("glycomet", ["metformin", "glucophage"]),
    ("glucophage", ["metformin", "glycomet"]),
    ("amaryl", ["glimepiride", "glimisave"]),
    ("glimisave", ["glimepiride", "amaryl"]),
    ("januvia", ["sitagliptin"]),
    ("galvus", ["vildagliptin"]),
    ("jardiance", ["empagliflozin"]),
    ("forxiga", ["dapagliflozin"]),
    ("mixtard", ["insulin human"]),
    ("lantus", ["insulin glargine"]),
    ("novorapid", ["insulin aspart"]),
    ("humalog", ["insulin lispro"]),
    ("wysolone", ["prednisolone", "omnacortil"]),
    ("omnacortil", ["prednisolone", "wysolone"]),
    ("dexona", ["dexamethasone", "decadron"]),
    ("medrol", ["methylprednisolone"]),
    ("defcort", ["deflazacort", "calcort"]),
    ("allegra", ["fexofenadine"]),
    ("cetrizine", ["cetirizine", "cetzine", "okacet"]),
    ("cetzine", ["cetirizine", "okacet"]),
    ("okacet", ["cetirizine", "cetzine"]),
    ("montair", ["montelukast", "romilast"]),
    ("romilast", ["montelukast", "montair"]),
    ("avil", ["pheniramine"]),
    ("atarax", ["hydroxyzine"]),
    ("asthalin", ["salbutamol", "ventolin", "derihaler"]),
    ("ventolin", ["salbutamol", "asthalin"]),
    ("budecort", ["budesonide", "pulmicort"]),
    ("pulmicort", ["budesonide", "budecort"]),
    ("seroflo", ["salmeterol fluticasone", "aerocort"]),
    ("foracort", ["formoterol budesonide"]),
    ("duolin", ["ipratropium salbutamol", "combivent"]),
    ("tiova", ["tiotropium", "spiriva"]),
    ("spiriva", ["tiotropium", "tiova"]),
    ("calmpose", ["diazepam", "valium"]),
    ("valium", ["diazepam", "calmpose"]),
    ("alzolam", ["alprazolam", "restyl", "alprax"]),
    ("restyl", ["alprazolam", "alzolam"]),
    ("alprax", ["alprazolam", "alzolam", "restyl"]),
    ("nexito", ["escitalopram", "cipralex", "stalopam"]),
    ("stalopam", ["escitalopram", "nexito"]),
    ("frisium", ["clobazam"]),
    ("valparin", ["valproate", "epilex"]),
    ("eptoin", ["phenytoin", "dilantin"]),
    ("tegrital", ["carbamazepine"]),
    ("gabapin", ["gabapentin"]),
    ("pregabalin", ["lyrica", "pregalin"]),
    ("pregalin", ["pregabalin", "lyrica"]),
    ("lyrica", ["pregabalin", "pregalin"]),
    ("shelcal", ["calcium vitamin d3"]),
    ("calcimax", ["calcium", "shelcal"]),
    ("becosules", ["b complex", "beplex"]),
    ("beplex", ["b complex", "becosules"]),
    ("neurobion", ["vitamin b12 b6 b1", "methylcobalamin"]),
    ("methylcobalamin", ["mecobalamin", "methycobal", "neurobion forte"]),
    ("methycobal", ["methylcobalamin", "mecobalamin"]),
    ("limcee", ["vitamin c", "ascorbic acid"]),
    ("zincovit", ["multivitamin zinc"]),
    ("revital", ["multivitamin"]),
    ("supradyn", ["multivitamin"]),
    ("iron sucrose", ["venofer", "orofer"]),
    ("orofer", ["iron sucrose"]),
    ("norflox tz", ["norfloxacin tinidazole", "nortini"]),
    ("metrogyl", ["metronidazole", "flagyl"]),
    ("flagyl", ["metronidazole", "metrogyl"]),
    ("oflox", ["ofloxacin", "zanocin"]),
    ("zanocin", ["ofloxacin", "oflox"]),
    ("o2", ["ofloxacin ornidazole"]),
    ("taxim o", ["cefixime ofloxacin"]),
    ("zifi", ["cefixime"]),
    ("sumo", ["nimesulide paracetamol"]),
    ("zerodol", ["aceclofenac"]),
    ("zerodol sp", ["aceclofenac serratiopeptidase paracetamol"]),
    ("hifenac", ["aceclofenac"]),
]

# --- fixed values: prompt templates of chat models ---
PROMPTS: dict[str, dict[str, str]] = {
    "chatml": {"system": "<|im_start|>system\n", "system_end": "<|im_end|>\n", "user": "<|im_start|>user\n", "user_end": "<|im_end|>\n", "assistant": "<|im_start|>assistant\n", "assistant_end": "<|im_end|>\n", "no_thinking": "<think>\n\n</think>\n\n"},
    "gemma": {"system": "", "system_end": "\n\n", "user": "<start_of_turn>user\n", "user_end": "<end_of_turn>\n", "assistant": "<start_of_turn>model\n", "assistant_end": "<end_of_turn>\n", "no_thinking": ""},
    "llama3": {"system": "<|start_header_id|>system<|end_header_id|>\n\n", "system_end": "<|eot_id|>", "user": "<|start_header_id|>user<|end_header_id|>\n\n", "user_end": "<|eot_id|>", "assistant": "<|start_header_id|>assistant<|end_header_id|>\n\n", "assistant_end": "<|eot_id|>", "no_thinking": ""},
}
N_CTX, MAX_TOKENS, RESERVE = 2048, 512, 300
