"""Word lists, patterns and thresholds of the text rules, in English and Arabic."""

from __future__ import annotations

ENGLISH_STOPWORDS = """a about above after again against all also am an and any are as at be because been before being
below between both but by can could did do does doing down during each few for from further had has have having he her
here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on
once only or other our ours ourselves out over own same she should so some such than that the their theirs them
themselves then there these they this those through to too under until up very was we were what when where which while
who whom why will with would you your yours yourself yourselves use using used get gets make makes made one two new
may might must shall per via etc"""

COMMERCE_STOPWORDS = """add cart buy shop shopping order orders price prices sale offer offers shipping delivery
return returns stock available availability item items product products quantity qty wishlist review reviews reviewed
rating ratings share customer customers sku category categories brand brands home page click read more less details
description sar aed egp kwd qar usd"""

ARABIC_STOPWORDS = """في من على الى إلى عن مع هذا هذه ذلك تلك التي الذي الذين او أو و ثم كل بعض قد لا لم لن ما ماذا كيف
هو هي هم نحن انت أنت انا أنا كان كانت يكون تكون عند حتى اذا إذا لكن بين كما ايضا أيضا غير بعد قبل حيث فيه فيها به بها له لها
يا ان أن إن اي أي هل منتج منتجات المنتج المنتجات السعر سعر اضف أضف السلة سلة شراء اشتري الشحن شحن مجاني التوصيل توصيل
متوفر متوفرة المخزون الكمية تقييم تقييمات مراجعات ريال درهم جنيه دينار"""

ARTICLES = ["وال", "بال", "فال", "كال"]

POSITIVE = """good great excellent amazing love loved best perfect wonderful fantastic awesome nice happy recommend recommended
soft shiny fast worth beautiful ممتاز ممتازة رائع رائعة جميل جميلة حلو حلوة احسن أفضل افضل انصح أنصح ناعم ناعمة لمعان سريع سريعة
يستاهل مرضي راضية راضي"""

NEGATIVE = """bad poor terrible awful worst hate hated disappointing disappointed useless waste fake damaged broken late slow
expensive overpriced itchy irritating سيء سيئ سيئة فظيع فظيعة مخيب مخيبة غالي غالية تقليد مقلد تالف متأخر بطيء حكة تهيج ماأنصح
فاشل فاشلة"""

#: Theme, label, English words (whole words), Arabic parts (anywhere).
THEMES = [
    ("price", "Price / value", "price|priced|pricing|expensive|cheap|cheaper|costly|value|worth|overpriced|affordable|pricey", "سعر|اسعار|غالي|غالية|رخيص|رخيصة|قيمة|يستاهل|مكلف|رخيصه|غاليه"),
    ("delivery", "Delivery / shipping", "delivery|shipping|shipped|arrived|courier|late|delay|delays|fast shipping|slow shipping", "توصيل|التوصيل|شحن|الشحن|وصل|وصول|متأخر|تأخير|سريع"),
    ("packaging", "Packaging", "packaging|package|packed|box|bottle|leak|leaking|damaged|seal|sealed|broken", "تغليف|التغليف|عبوه|العبوه|علبه|تسريب|تالف|مفتوح|ختم|مكسور|مكسوره"),
    ("authenticity", "Authenticity / original", "authentic|original|genuine|fake|counterfeit|replica|legit", "اصلي|أصلي|اصليه|أصلية|تقليد|مقلد|مقلدة|مغشوش|حقيقي"),
    ("scent", "Scent / fragrance", "scent|smell|smells|fragrance|perfume|odour|odor|aroma", "رائحه|رائحة|عطر|عطور|ريحه|ريحة|نفاذ|فوحان"),
    (
        "texture",
        "Texture / feel",
        "texture|creamy|thick|thin|sticky|greasy|silky|smooth|lightweight|heavy|oily|dry touch|white cast",
        "قوام|ملمس|ثقيل|خفيف|لزج|دهني|دهنيه|ناعم|كريمي|ينشف|بينشف|ناشف|علامات بيض|بيضاء|يعرق|رؤوس السود",
    ),
    (
        "results",
        "Results / effectiveness",
        "results?|effective|effectiveness|works?|working|difference|improved?|improvement|soft|shiny|shine|hydrated?|moisturiz",
        "نتيجه|نتائج|فعاليه|فعال|فرق|تحسن|ناعم|لمعان|ترطيب|تحف|حمايه|حمايت|مسام|منفعش|ما نفعش",
    ),
    (
        "irritation",
        "Irritation / allergy",
        "irritat|allergy|allergic|itch|itchy|burn|burning|rash|sensitive|reaction|sting|breakout|break out|prick",
        "حساسيه|تهيج|حكه|حرق|احمرار|تفاعل|حساس|بريك|وخز",
    ),
    ("hair_loss", "Hair loss", r"hair\s*loss|shedding|fall(?:ing)?\s*out|bald", r"تساقط|يسقط|سقط|صلع|كثافة\s+الشعر"),
    ("customer_service", "Customer service", r"customer\s*service|support|refund|return|exchange|response|helpful|rude", r"خدمه\s+العملاء|خدمة\s+العملاء|دعم|استرجاع|استبدال|رد|موظف"),
]
STORE_THEMES = ["delivery", "customer_service"]

#: Fact, label, pattern (regardless of case). \b is a boundary of ASCII words.
ATTRIBUTES = [
    ("ingredients", "Ingredients list", r"ingredients|\binci\b|المكونات|مكونات"),
    ("how_to_use", "How to use", r"how to use|directions|instructions for use|طريقة (الاستخدام|الإستخدام|الاستعمال)|كيفية الاستخدام|طريقة الاستعمال"),
    ("benefits", "Benefits", r"benefits|فوائد|المميزات|مميزات"),
    ("size", "Size / volume", r"\d+(?:[.,]\d+)?\s?(?:ml|g|gm|gr|oz|fl\.?\s?oz|مل|ملل|جم|جرام|غرام)(?![a-z])"),
    (
        "hair_type",
        "Hair type",
        r"(?:curly|wavy|straight|dry|oily|damaged|colou?r(?:ed|-treated)|fine|thick|frizzy|thin)\s+hair|all hair types|hair type|شعر\s+(?:مجعد|جاف|دهني|تالف|مصبوغ|خشن|ناعم|متقصف|كيرلي)|(?:جميع|لكل)\s+أنواع\s+الشعر|نوع الشعر",
    ),
    (
        "skin_type",
        "Skin type",
        r"(?:dry|oily|combination|sensitive|normal|acne[\s-]prone|mature)\s+skin|all skin types|skin type|بشرة\s+(?:جافة|دهنية|مختلطة|حساسة|عادية)|(?:جميع|لكل)\s+أنواع\s+البشرة|نوع البشرة",
    ),
    (
        "key_actives",
        "Key active ingredients",
        r"keratin|argan|hyaluronic|niacinamide|retinol|vitamin\s?[a-e]\b|collagen|biotin|salicylic|ceramide|shea|كيراتين|أرجان|ارجان|هيالورونيك|نياسيناميد|ريتينول|فيتامين|كولاجين|بيوتين|سيراميد|شيا",
    ),
    ("sulfate_free", "Sulfate-free", r"sul(?:f|ph)ate[\s-]*free|no sul(?:f|ph)ates?|(?:بدون|خال[يٍ]?\s+من)\s+(?:ال)?سلفات"),
    ("paraben_free", "Paraben-free", r"paraben[\s-]*free|no parabens?|(?:بدون|خال[يٍ]?\s+من)\s+(?:ال)?بارابين"),
    ("silicone_free", "Silicone-free", r"silicone[\s-]*free|no silicones?|(?:بدون|خال[يٍ]?\s+من)\s+(?:ال)?سيليكون"),
    ("fragrance_free", "Fragrance-free", r"fragrance[\s-]*free|unscented|(?:بدون|خال[يٍ]?\s+من)\s+(?:ال)?(?:عطر|عطور)"),
    ("cruelty_free", "Cruelty-free", r"cruelty[\s-]*free|not tested on animals|(?:لم يتم|غير)\s+(?:اختباره|مختبر|مختبرة)\s+على\s+الحيوانات"),
    ("vegan", "Vegan", r"\bvegan\b|نباتي"),
    ("halal", "Halal", r"\bhalal\b|حلال"),
    ("natural", "Natural / organic", r"\borganic\b|\bnatural\b|عضوي|طبيعي"),
    ("dermatologist", "Dermatologically tested", r"dermatolog|أطباء (?:ال)?جلد|طبيب (?:ال)?جلد|مختبر(?:ة)? (?:من قبل|تحت إشراف)"),
    ("spf", "Sun protection (SPF)", r"\bspf\b|sun protection|واقي (?:من )?الشمس|حماية من (?:أشعة )?الشمس"),
    ("origin", "Country of origin", r"made in|country of origin|صنع في|صُنع في|بلد المنشأ|المنشأ"),
    ("warnings", "Warnings / precautions", r"warning|caution|precautions|avoid contact with (?:the )?eyes|تحذير|تحذيرات|احتياطات"),
]

TITLE_LENGTH = (30, 65)
META_LENGTH = (70, 160)
LEAST_WORDS = 50
DUPLICATE, SIMILAR = 80, 60
LEAST_ALT_COVERAGE = 80
GOOD_SCORE = 85
LEAST_TOKENS = 20
#: Host names that say nothing of the store, and second-level labels of public suffixes.
GENERIC_SUBDOMAINS = ["www", "m", "shop", "store", "en", "ar", "fr", "de", "uk", "us"]
