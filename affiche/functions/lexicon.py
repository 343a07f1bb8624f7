"""Word lists and patterns of the French listings domain.

Every list here is a set of FIXED VALUES: results depend on the exact entries
(and, for the months and the selectors, on their order).
"""

# --- fixed values: months in the order they are tried -----------------------
MONTHS = {
    "janvier": "01", "février": "02", "mars": "03", "avril": "04",
    "mai": "05", "juin": "06", "juillet": "07", "août": "08",
    "septembre": "09", "octobre": "10", "novembre": "11", "décembre": "12",
    "janv": "01", "févr": "02", "avr": "04",
    "juil": "07", "sept": "09", "oct": "10", "nov": "11", "déc": "12",
}

# --- fixed values: words of an event for families or children ---------------
FAMILY = [
    "spectacle", "spectacle jeune", "jeune public",
    "conte", "contes", "heure du conte", "lecture",
    "stage vacances", "stage enfant", "stage",
    "en famille", "pour les enfants", "pour les familles",
    "familial", "sortie famille",
    "à partir de 3", "à partir de 4", "à partir de 5",
    "à partir de 6", "à partir de 7", "à partir de 8",
    "dès 3 ans", "dès 4 ans", "dès 5 ans",
    "dès 6 ans", "dès 7 ans", "dès 8 ans",
    "3-6 ans", "4-8 ans", "5-10 ans", "6-10 ans", "6-12 ans",
    "festival", "fête", "carnaval", "kermesse",
    "chasse aux oeufs", "chasse au trésor",
    "journée portes ouvertes", "portes ouvertes",
    "vacances", "halloween", "noël", "noel", "pâques",
    "cinéma plein air", "ciné-goûter",
    "balade", "randonnée", "sortie nature",
]

# --- fixed values: words of institutional or all-year content ----------------
INSTITUTIONAL = [
    # early childhood and care
    "petite enfance", "relais petite enfance",
    "crèche", "creche", "halte-garderie", "garderie",
    "assistante maternelle", "assistant maternel",
    "relais assistante", "ram ",
    # school
    "restaurant scolaire", "restauration scolaire", "cantine",
    "vie scolaire", "établissement scolaire", "etablissement scolaire",
    "inscription scolaire", "inscriptions scolaires",
    "activité périscolaire", "activités périscolaires",
    "accueil périscolaire", "temps périscolaire",
    "périscolaire", "periscolaire",
    "carte scolaire", "transport scolaire",
    "tarif périscolaire",
    # all-year courses
    "cours hebdomadaire", "cours annuel", "toute l'année",
    "gala de danse", "gala annuel", "spectacles de danses de fin d'année",
    "septembre à juin", "de septembre à",
    "trimestre", "semestre",
    "du lundi au vendredi",
    "accueil de loisirs", "accueils de loisirs",
    "quotient familial", "quotient individuel",
    # site navigation
    "règlement intérieur",
    "vos démarches", "votre mairie", "la ville et vous",
    "demande de prestation", "formulaire",
    "se connecter", "je m'inscris", "mon compte",
    "mentions légales", "politique de confidentialité",
    "plan du site", "annuaire", "newsletter",
    "espace personnel", "billetterie weezevent",
    "lire la suite", "plus de détails", "en savoir plus",
    "organigramme", "à votre service",
    "education et jeunesse",
    "des espaces de jeux", "aires de jeux",
    "parcours de santé",
    "opération tranquillité vacances",
    "l'esprit tranquille",
    "les parents concernés sont",
    "le ccas", "service aide à la personne",
    "résidence renaissance",
    # town administration
    "horaires d'ouverture", "horaires de",
    "conseil municipal", "conseil des jeunes",
    "pôle jeunesse", "pole jeunesse",
    "s.i.j", "sij du",
    "retour en photos", "retour en images",
    "collecte de sang", "don du sang",
    "sondage", "enquête publique", "enquete publique",
    "recensement", "élections", "elections",
    "travaux ", "chantier ", "déviation",
    "permanence ", "réunion publique", "reunion publique",
    "commémoration", "commemoration", "cérémonie", "ceremonie",
    "lettre du maire", "mot du maire",
    "rétrospective", "retrospective",
    "covid", "pandémie",
    "sécheresse", "canicule", "influenza",
    "au sein de", "vous souhaitez participer",
    "tier devient", "devient dott",
    "carré des arts",
    "ateliers parents-enfants", "ateliers parent-enfant",
]

# --- fixed values: titles that only name a section ---------------------------
GENERIC_TITLES = [
    "sport", "sports", "ecriture", "écriture", "multimedia", "multimédia",
    "danse", "musique", "théâtre", "theatre", "peinture", "dessin",
    "yoga", "judo", "karaté", "karate", "gym", "gymnastique",
    "natation", "tennis", "football", "basket", "rugby",
    "arts plastiques", "arts du spectacle", "bien-être", "bien être",
    "arts vivants", "arts martiaux",
    "danse contemp'jazz", "danse contemporaine", "danse classique",
    "danse jazz", "danse moderne", "danse hip-hop",
    "informations", "résultats", "contact", "accueil",
    "enfance jeunesse", "enfance – jeunesse", "jeunesse",
    "familles", "seniors", "les animations seniors",
    "la saison", "en famille", "sport en famille",
    "cliquez-ici", "tout voir",
    "jeune public", "spectacle", "café lecture",
    "activités artistiques", "activités culturelles",
    "mercredi et vacances :", "mercredi et vacances",
    "activ'jeunes", "stages vacances", "stages",
    "au sein de chanorier", "vous souhaitez participer",
    "vous souhaitez participer ?",
    "saison culturelle", "programmation scolaire",
    "spectacles amateurs",
    "avec nos partenaires", "toute la saison",
    "je réserve", "je reserve",
    "comédie musicale", "comedie musicale",
    "programme des animations",
    "activités de la bibliothèque", "activites de la bibliotheque",
    "carte des jpo des artistes 2021",
    "foot avec l'us croissy",
    "manifestations", "concours logo",
    "les nouvelles couleurs de la mpt",
    "les temps forts de notre fin de saison",
    "la 1000ième !", "la 1000ieme !",
    "ca y est la nouvelle saison a commencé !",
    "inscription : vacances scolaires",
    "accueil des mercredis et pendant les vacances scolaires",
]

# --- fixed values: first words of a title that is only a fragment ------------
FRAGMENT_STARTS = [
    "«", "»", "–", "—", "...", "…",
    "voici ", "certains de ", "liste des ",
    "galerie ", "dépliant ", "depliant ",
    "programme :", "programme:",
    "rendez-vous de ", "retrouvez ",
    "catalogue ", "administrateur", "administrator",
    "une initiative", "l'arrêté", "l'arrete", "'arrêté",
    "du côté des", "du cote des",
    "mercredi ", "jeudi ", "vendredi ", "samedi ", "dimanche ",
    "lundi ", "mardi ",
    "à voir en", "a voir en",
    "tous les évènements", "tous les evenements",
    "salle ", "spectacles passés", "spectacles passes",
    "spectacles sésame",
    "fin du ", "1. fin ", "1.fin ",
]

# --- fixed values: navigation labels ------------------------------------------
NAV_LABELS = [
    "spectacles", "événements", "evenements", "saison",
    "programmation", "agenda", "activités", "activites",
]

# --- fixed values: words of a one-off event ------------------------------------
PUNCTUAL = [
    "spectacle", "concert", "festival", "fête", "fete",
    "conte", "contes", "lecture",
    "stage", "stages", "vacances",
    "portes ouvertes", "kermesse", "carnaval",
    "chasse aux oeufs", "chasse au trésor",
    "atelier vacances", "stage vacances",
    "ciné-goûter", "cine-gouter", "cinéma plein air",
    "halloween", "noël", "noel", "pâques", "paques",
    "exposition",
    "représentation", "representation",
]

# --- fixed values: words in the path of an agenda page -------------------------
AGENDA_PATH = [
    "agenda", "actualite", "actualité", "actualites", "actualités",
    "evenement", "événement", "evenements", "événements",
    "event", "events", "programmation", "programme",
    "spectacle", "spectacles", "saison",
    "animation", "animations", "activite", "activité",
    "activites", "activités", "jeunesse", "enfant",
]

# --- fixed values: words in the text of a link to an agenda page ---------------
AGENDA_LINK_TEXT = [
    "agenda", "actualité", "actualités", "actualite", "actualites",
    "événements", "evenements", "programmation", "programme",
    "spectacles", "saison", "animations", "activités", "activites",
    "sorties", "que faire", "à venir", "prochainement",
    "news", "événement", "evenement",
]

# --- fixed values: words of a free event ----------------------------------------
FREE = [
    "gratuit", "gratuite", "gratuits", "gratuites",
    "entrée libre", "entree libre",
    "accès libre", "acces libre",
    "participation libre", "sans frais",
]

# --- fixed values: selectors of event blocks, in the order they are tried -------
BLOCK_SELECTORS = [
    "article.event", ".agenda-item", ".event-item",
    ".views-row", ".node--type-event", "li.event",
    ".activity-item", ".activite", "article.activity",
    ".spectacle-item", ".show-item", "article.spectacle",
    ".program-item", ".saison-item",
    ".tribe-events-calendar-list__event",
    ".bandeau_item", ".film",
    ".list_item", ".post-item",
]
FALLBACK_SELECTORS = ["article", ".card"]
GROUPED_TAGS = ["article", "div", "li", "section"]

# --- fixed values: where navigation lives on a page ------------------------------
NAV_ANCESTOR_TAGS = ["nav", "footer", "aside"]
NAV_ANCESTOR_CLASSES = ["menu", "nav", "sidebar", "breadcrumb", "footer-widget", "footer-area"]
NAV_ANCESTOR_LEVELS = 5
LINK_ZONE_TAGS = ["nav", "header"]
LINK_ZONE_CLASSED_TAGS = ["div", "ul"]
LINK_ZONE_CLASS_PARTS = ["menu", "nav", "navigation", "header"]

# --- fixed values: classes of a summary element ----------------------------------
SUMMARY_CLASS_PARTS = ["desc", "summary", "body", "chapo", "intro", "excerpt", "resume", "résumé"]
SUMMARY_TAGS = ["p", "div", "span"]
TITLE_TAGS = ["h2", "h3", "h4", "a"]
HEADING_TAGS = ["h2", "h3", "h4"]

# --- fixed values: file and domain endings ----------------------------------------
FILE_ENDINGS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip"]
DOMAIN_ENDINGS = ["fr", "com", "org", "net", "eu"]

# --- fixed values: limits and defaults ---------------------------------------------
MIN_TITLE_CHARS = 10
MIN_BLOCK_CHARS = 30
MIN_BLOCKS = 2
MIN_PARAGRAPH_CHARS = 10
MAX_SUMMARY_CHARS = 300
MAX_PAGES_PER_SITE = 50
PAST_GRACE_DAYS = 30
FIRST_PAST_YEAR = 2000
DEFAULT_AGE_MIN = 5
DEFAULT_AGE_MAX = 10
OPEN_AGE_MAX = 12

# --- fixed values: display texts ------------------------------------------------------
CATEGORY_LABELS = {"library": "Bibliothèque", "mjc": "MJC", "theatre": "Théâtre"}
PRICE_FREE = "Gratuit"
PRICE_UNKNOWN = "Non renseigné"
WEEKDAYS = ["dim.", "lun.", "mar.", "mer.", "jeu.", "ven.", "sam."]
MONTH_NAMES = [
    "janvier", "février", "mars", "avril", "mai", "juin", "juillet",
    "août", "septembre", "octobre", "novembre", "décembre",
]

# --- fixed values: white space of Unicode text (tab..CR, FS..US, NEL, NBSP, ...) -------
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# --- fixed values: typographic marks and what they are matched as ------------------------
QUOTES_AND_DASHES = "’‘“”–—"
PLAIN_QUOTES_AND_DASHES = "''\"\"--"
