"""URL filters: rules by host and path, and for the rest logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlight.llm.common import ASCII_LOWER, ASCII_UPPER

#: rule (host and path prefix), verdict
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: The small labelled table: addresses to block (gambling, sex, quick money, medicines, fakes, pirated files, advertising networks, phishing, junk) and to allow. All were made up or named from memory for this table.
BLOCK = """royal-slots.com/play slotsmania777.net/spin-now luckyspinz.xyz/bonus bingo-palace.co.uk/join pokerstarz-room.com/deposit holdem-poker24.de/bonus roulette-monarch.io/live blackjack-vip.com/promo jackpotcity-slots.top/claim megajackpotz.click/lotto
lotto-results-now.info/ticket lottery-winners-club.biz/claim sportsbetting-tips.bet/odds betonline-365.com/signup betting-bonus-codes.net/bonus gamble-online.fr/jeux gambling-guide.xyz/review slot-machines-online.com/play/slots keno-live.bet/draw baccarat-vip.top/table
xxx-tube-videos.com/watch porn-hd-clips.net/video pornstar-gallery.xyz/pics hotsexcams.com/live sexy-webcam-girls.net/chat livesex-chat.biz/room nude-celebs-pics.info/gallery teen-cams-xxx.top/live milf-tube.xxx/video escort-girls-city.com/book escorts-berlin24.de/anzeigen
hookup-tonight.click/join singles-dating-now.com/signup dating-hot-singles.net/profile sexdating-kontakte.de/anmelden erotik-kontakte.de/chat fetish-cams.xxx/room hentai-porn.xyz/watch camgirls-online.net/live onlynudes.top/gallery swinger-kontakte.info/join
fast-payday-loans.com/apply payday-cash-advance.net/apply instant-loan-approval.biz/form bad-credit-loans.xyz/apply quick-cash-today.click/offer loans-no-credit-check.info/apply make-money-online.biz/earn earn-from-home-fast.com/start get-rich-fast.xyz/secret millionaire-secret-system.top/join
bitcoin-doubler.io/invest crypto-profit-robot.com/signup bitcoin-profit-trader.net/register forex-robot-signals.biz/buy forex-profit-system.com/signup binary-options-trader.top/deposit crypto-giveaway-live.xyz/claim eth-airdrop-claim.click/wallet trading-robot-profit.de/start investment-doubler.biz/plan
viagra-online-shop.com/order buy-viagra-cialis.net/order cialis-generic-online.biz/buy online-pharmacy-rx.top/meds canadian-rx-drugstore.com/order no-prescription-meds.xyz/buy generic-meds-online.info/order weightloss-keto-diet.com/buy keto-slim-gummies.xyz/trial diet-miracle-burner.net/order testosterone-booster-shop.biz/buy male-enhancement-rx.top/trial
hgh-steroids-shop.com/order cbd-gummies-offer.click/trial lose-weight-fast-now.info/secret xanax-valium-online.net/buy tramadol-no-rx.biz/order hair-regrowth-miracle.top/offer detox-slim-tea.xyz/offer potenzmittel-rezeptfrei.de/bestellen
replica-watches-shop.com/rolex replica-handbags-outlet.net/sale rolex-replica-store.biz/buy louis-outlet-sale.top/bags discount-oakleys-outlet.xyz/sale fake-designer-shoes.com/shop ugg-outlet-sale.info/boots luxury-replica-bags.cn/buy jerseys-wholesale-outlet.net/shop fake-id-passport.biz/order
buy-followers-likes.com/instagram instagram-likes-buy.net/order buy-cheapest-backlinks.xyz/seo seo-backlinks-service.biz/buy traffic-exchange-hits.com/join essay-writing-cheapest.top/order buy-essays-online.net/order buy-reviews-5star.biz/order clickbait-viral-buzz.xyz/shock viral-shock-videos.click/watch
warez-downloads.net/cracks crack-keygen-serial.com/download keygen-full-version.xyz/download torrent-movies-hd.to/download torrentz-mirror.cc/torrent watch-movies-online-hd.top/stream putlocker-stream-hd.xyz/watch streaming-films-gratuit.click/film nulled-scripts-themes.net/download serial-keys-cracked.info/crack
mp3-download-juice.cc/mp3 cracked-apk-mods.xyz/apk rom-iso-downloads.to/iso pirate-proxy-list.click/proxy hd-stream-kostenlos.top/film iptv-premium-channels.xyz/buy game-cheats-hacks.net/hack aimbot-hacks-store.top/download account-generator-hack.click/generate vbucks-generator.xyz/generate
adserver-network.com/banner adnxs-sync.net/pixel bannerads-exchange.com/click popunder-network.net/pop clicktracker-pixel.com/pixel affiliate-offers-network.com/offer tracking-pixel-sync.net/sync popcash-adserver.biz/serve adclick-redirect.com/redirect adsyndication-hub.net/serve
affiliate-clicks.top/go retarget-pixel-ad.com/pixel push-notification-spots.xyz/subscribe doubleclick-banner.biz/ad leadgen-affiliate.net/offer survey-rewards-prize.click/claim giftcard-prize-claim.top/claim iphone-giveaway-prize.xyz/claim you-won-prize.click/claim sweepstakes-entry-now.com/enter
paypal-login-verify.top/account secure-bank-verify.xyz/login account-suspended-verify.click/login appleid-unlock-verify.net/signin netflix-billing-update.top/account amazon-prize-claim.click/verify wallet-connect-verify.xyz/wallet microsoft-support-alert.click/virus virus-alert-cleaner.top/download pc-speedup-cleaner.net/download
driver-updater-pro.biz/download toolbar-download-now.com/install coupon-codes-deals.click/deal discount-coupon-deals.xyz/promo flash-sale-deals.top/offer psychic-love-reading.click/chat love-spells-caster.biz/order miracle-cure-secret.xyz/buy penny-auction-deals.top/bid mlm-income-system.biz/join""".split()
ALLOW = """channel4.com/news latimes.com/section/science theguardian.com/world lefigaro.fr/planete zeit.de/wissenschaft elmundo.es/cultura reuters.com/markets sueddeutsche.de/politik washingtonpost.com/opinions liberation.fr/societe
corriere.it/cronache nrc.nl/nieuws irishtimes.com/culture seattletimes.com/weather thehindu.com/sci-tech japantimes.co.jp/life lavanguardia.com/deportes ouest-france.fr/bretagne abendblatt.de/hamburg essexlive.news/village
wikidata.org/wiki/otter wiktionary.org/wiki/word britannica.com/animal/heron gutenberg.org/ebooks archive.org/details/maps openstreetmap.org/history stackoverflow.com/questions github.com/explore python.org/doc mozilla.org/about
kernel.org/releases debian.org/distrib apache.org/licenses postgresql.org/docs rust-lang.org/learn w3.org/standards ietf.org/rfc gnu.org/manual openbsd.org/faq cplusplus.com/reference
mit.edu/courses ox.ac.uk/admissions cam.ac.uk/research sussex.ac.uk/study winchester.ac.uk/library ethz.ch/forschung sorbonne.fr/bibliotheque tu-berlin.de/mathematik uva.es/alumnos helsinki.fi/research
middlesex.edu/catalog stanford.edu/events bethel.edu/music utrecht-university.nl/geology kyoto-u.ac.jp/labs lse.ac.uk/economics uni-heidelberg.de/studium polytechnique.fr/recherche caltech.edu/seismology wesleyan.edu/admission
nasa.gov/missions nih.gov/health europa.eu/policies senedd.wales/bills bundestag.de/ausschuesse service-public.fr/demarches gov.scot/passport metoffice.gov.uk/forecast usgs.gov/quakes census.gov/data
who.int/diseases un.org/peace unesco.org/heritage worldbank.org/indicators ecb.europa.eu/stats loc.gov/collections noaa.gov/tides nps.gov/trails cdc.gov/vaccines royalsociety.org/grants
nature.com/articles sciencedirect.com/journal plos.org/biology arxiv.org/abs jstor.org/stable springer.com/chapter pubmed.org/abstract chemistryworld.com/features quantamagazine.org/mathematics aps.org/physics
tate.org.uk/art louvre.fr/oeuvres prado.es/coleccion rijksmuseum.nl/rembrandt moma.org/artists deutsches-museum.de/luftfahrt operabase.com/tenor bolshoi.ru/ballet royalalberthall.com/concerts elizabethan-theatre.org/plays
nationaltrust.org.uk/gardens rspb.org.uk/birds kew.org/plants woodlandtrust.org.uk/oak alpenverein.de/huetten ramblers.org.uk/walks cyclinguk.org/routes climbing-guide.com/alps sailing-club.org/regatta windermere-boats.co.uk/lake
bakery-corner.com/sourdough marmiton.org/recettes chefkoch.de/rezepte seriouseats.com/pasta kitchen-diary.net/soup cheesemakers.org/brie teahouse-blog.com/oolong vineyard-notes.fr/bordeaux gardeners-almanac.org/roses beekeeping-notes.net/hives
ikea.com/sofas decathlon.fr/velos bookshop.org/poetry waterstones.com/novels toyshop-lane.co.uk/trains hardware-direct.com/drills bicycle-workshop.de/bremsen music-store.de/klavier pottery-studio.com/glaze woolcraft.net/knitting
deutsche-bahn.de/fahrplan sncf.com/horaires nationalrail.co.uk/stations airport-guide.org/terminals hostel-freiburg.de/zimmer lonelyplanet.com/patagonia visitwales.com/castles camping-provence.fr/tarifs hotel-bristol.it/camere freetown-travel.org/beaches
mayoclinic.org/asthma patient.info/migraine pharmacology-society.org/meeting nursing-times.net/wards dentist-street.co.uk/appointments therapists-directory.org/find kinderarzt-praxis.de/impfung croix-rouge.fr/dons hospice-care.org.uk/volunteers psychology-review.org/memory
bankofengland.co.uk/inflation sparkasse.de/filialen economist.com/finance credit-union.org/members pensions-advice.gov.uk/plan tax-office.gov.au/forms accountants-weekly.com/audit insurance-history.org/lloyds statistics-norway.no/prices mortgage-law-review.org/cases
chess.com/openings go-federation.org/joseki cricket-archive.org/scores uefa.com/fixtures marathon-club.de/lauf tennis-club-lyon.fr/tournoi swimming.org/pools handball-liga.de/tabelle model-railways.net/layouts bridge-club.org/results
scouts.org.uk/camps parish-council.org.uk/minutes choir-society.org/rehearsals school-district.k12.us/calendar grundschule-nord.de/eltern college-lycee.fr/menu kindergarten-sonne.de/gruppen library-friends.org/storytime village-hall.co.uk/hire rotary-club.org/projects
personal-essays.net/2019/autumn travel-sketches.org/2021/lisbon notes-on-type.com/serif old-maps-blog.net/antwerp astronomy-diary.org/saturn local-history-forum.org/topic linguistics-blog.net/vowels poems-and-letters.org/keats photo-journal.fr/2018/neige family-tree-forum.co.uk/census
weather-station.info/today radio-classique.fr/emissions podcast-history.com/rome documentary-films.org/ocean orchestra-city.com/season jazz-cellar.de/programm comic-library.net/manga language-exchange.org/groups translators-forum.net/idioms dictionary-project.org/etymology""".split()
#: Ways in which a page of a site may be addressed, by turns.
PREFIXES, TAILS = ("", "www.", "m.", "blog."), ("", "/", "/index", "/archive/7")
FEATURES, GRAMS = 2**15, (2, 3, 4)
#: Least probability that blocks: of sites held out by registered name (three folds), 0.95 of those blocked are to be, and 0.92 of those that are to be are blocked.
THRESHOLD = 0.35


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without :// or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; '' without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits (the first by code point among equally long ones), or null. A rule fits its host and all subdomains, on paths that begin with its path."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, slash, rest = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(r)).otherwise(found)
    return found


def grams(host: Column, path: Column) -> Column:
    """The distinct n-grams of the host and of the path, each between marks for its ends."""
    def of(text: Column, mark: str) -> list[Column]:
        framed = F.concat(F.lit(mark + "^"), text, F.lit("$"))
        return [F.when(F.length(framed) > n, F.transform(F.sequence(F.lit(2), F.length(framed) - n + 1), lambda i: F.concat(F.lit(mark), F.substr(framed, i, F.lit(n))))).otherwise(F.array().cast("array<string>")) for n in GRAMS]

    return F.array_distinct(F.concat(*of(host, "h"), *of(path, "p")))


def features(df: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="__grams", outputCol="__features").transform(df.withColumn("__grams", grams(F.col(host), F.col(path))))


def labelled(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, label (1: block), and the registered name by which parts may be held out. Each address of BLOCK and ALLOW stands with its path and as bare host."""
    rows = []
    for found, label in ((BLOCK, 1.0), (ALLOW, 0.0)):
        for i, x in enumerate(found):
            name, slash, rest = x.partition("/")
            rows += [(f"https://{PREFIXES[i % 4]}{name}{slash}{rest}{TAILS[(i // 4) % 4]}", label, name), (f"https://{PREFIXES[(i + 1) % 4]}{name}/", label, name)]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y}D, '{n}')" for u, y, n in rows) + " AS t(url, label, name)")


def train(table: DataFrame) -> LogisticRegressionModel:
    rows = table.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label")
    return LogisticRegression(featuresCol="__features", labelCol="label", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y", regParam=0.003, maxIter=60).fit(features(rows).coalesce(1))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, threshold: float = THRESHOLD, key: str = "page_id", url: str = "url", model: LogisticRegressionModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's probability of block) of every row of pages.

    verdict: the rule's, else block where score >= threshold. Null urls and urls without :// have empty hosts and paths,
    which no rule fits and the model judges like any other. Urls are judged whole, however long. Repeated rows are judged
    alike, and so are all of a host and path; null keys stay; other columns don't matter; an empty table stays empty.
    """
    rows = pages.select(F.col(key).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    scored = (model or train(labelled(pages.sparkSession))).transform(features(rows)).withColumn("score", vector_to_array("__p")[1])
    scored = scored.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", by_rule.alias("verdict"), "score")
