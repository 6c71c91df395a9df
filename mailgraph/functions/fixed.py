"""Values that decide results and therefore must not be changed freely."""

# Opening words of the company-property notice, with the company's name.
NOTICE_OPENING = "This e-mail is the property of "
NOTICE_OWNER = "Enron"

# Where a quoted or appended passage begins. Body text is cut from there on.
# Each list is one rule; the find-and-delete rules of body.py run between them. A marker whose
# end is the start of an earlier rule's marker yields to that one, hence the two exceptions.
CUTS_BEFORE_SLASHES = [
    "-*Original",
    "Sincerely",
    "Regards,",
    "Cordially,",
    "Thanks,",
    "Kind regard,",
]
CUTS_BEFORE_ADDRESSES = ["<[^>]*>", "-*Returned", "-*Forwarded"]
CUTS_LAST = [
    "Start Date:",
    "LOG MESSAGES:",
    "Delivery Date:",
    "PARSING FILE",
    "-*Energy",
    "COB NS(?!tart Date:)",
    "EOL D(?!elivery Date:)",
    "=",
    "-",
]

# Month names of mail dates; their first three letters are names, too.
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
]

# Subject prefixes by mail category.
REPLY_PREFIXES = ["RE:", "Re:", "re:"]
FORWARD_PREFIXES = ["FW:", "Fw:", "fw:"]
LONG_FORWARD_PREFIXES = ["Fwd:", "fwd:"]

# Zone suffixes deleted from export headers, in this order.
ZONE_SUFFIXES = [" (PST)", " (PDT)", " -0800", " -0700"]

# Leading characters skipped when taking a recipient's initials.
SKIPPED_INITIALS = ["'", "-", "_", "\\", "/", "<", ">", "@"]

# Folders merged and exported, first new file number, sampled snapshot range.
SENT_FOLDER = "sent"
SENT_ITEMS_FOLDER = "sent_items"
FIRST_MERGED_NUMBER = 20000
SAMPLED_SNAPSHOTS = (7, 33)

# Penn Treebank contraction endings and the words it splits in two.
CONTRACTION_ENDINGS = ["n't", "'s", "'re", "'ve", "'ll", "'d", "'m"]
SPLIT_WORDS = [
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
]
