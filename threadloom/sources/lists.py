"""Name lists: the ignore list of accounts that never enter the author table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.scalars import normal_name

# Account names ignored by default (bots, moderators, the marker of a deleted account).
DEFAULT_IGNORED_NAMES = """
alphabet_order_bot AmputatorBot anti-gif-bot Anti-ThisBot-IB autotldr B0tRank converter-bot exclaim_bot
GenderNeutralBot Good_Human_Bot_v2 haikusbot LearnDifferenceBot LuckyNumber-Bot nice___bot of_patrol_bot
Paid-Not-Payed-Bot Reddit-Book-Bot RemindMeBot SexPanther_Bot Shakespeare-Bot sneakpeekbot TheGratitudeBot
TotesMessenger Upside_Down-Bot useles-converter-bot WaitingToBeTriggered WaterIsWetBot wikipedia_answer_bot
WikiSummarizerBot TheDroidNextDoor agree-with-you BadDadBot Booty_Warrior_bot dadbot_2 dadbot_3000
FakespotAnalysisBot Grammar-Bot-Elite IamYodaBot LinkifyBot phonebatterylevelbot PORTMANTEAU-BOT
queen_of_england_bot SpambotSwatter SpunkyDred tiny_smile_bot twitterInfo_bot YoMommaJokeBot
FatFingerHelperBot WikiTextBot CommonMisspellingBot auto-xkcd37 HelperBot_ imguralbumbot RepostSleuthBot
wikipedia_text_bot TheSunflowerSeeds Bot_Metric CakeDay--Bot GoodBot_BadBot BigLebowskiBot jashxn
nice-scores NoGoogleAMPBot sub_doesnt_exist_bot WikiMobileLinkBot EncouragementRobot AnimalFactsBot eazeaze
epic_gamer_4268 ghost_of_dongerbot LimbRetrieval-Bot LoneKharnivore video_descriptionbot WhyNotCollegeBoard
youtubefactsbot _youtubot_ Alternative_Case_878 botrickbateman ClickableLinkBot I-Am-Dad-Bot SEND_NUKES_PLZ
UselessConversionBot Agrees_withyou AreYouDeaf autowikibot ectbot Generic_Reddit_Bot happy-cake-day-bot-
Philip_Jeffries SokkaHaikuBot table_it_bot UkraineWithoutTheBot BotThatSaysBro ConceptMajestic9156
kelvin_bot ReverseCaptioningBot ShelSilverstain SmileBot-2020 Chuck_Norris_Jokebot ConvertsToMetric
EmojifierBot haikubot-1911 I-AM-PIRATE MaxImageBot nkid299 resavr_bot serendipitybot SmallSubBot
smile-bot-2019 YodaOnReddit-Bot Anti_Fake_Yoda_Bot AntiObnoxiousBot bruh__bot LeEpicRedditor69 lerobinbot
not_so_magic_8_ball nwordcountbot oofed-bot RatedCommentBot same_post_bot same_subreddit_bot
SuicideAwarenessBot thebenshapirobot these_days_bot totes_meta_bot aardBot gifv-bot I_Love_You-BOT imdad_bot
metric_units YoUaReSoHiLaRiOuS HIPPAbot VettedBot ackchyually_bot amp-is-watching-you AntiLowEffortBot
auddbot BananaFactBot BlogSpammr Chick-fil-A_spellbot CoolDownBot demonitize_bot EverySingleThread
GANDHI-BOT HappyFriendlyBot icarebot kzreminderbot MCTerminologyBot Mentioned_Videos morejpeg_auto
profanitycounter remindditbot SaveVideo savevideobot The-Worst-Bot theHelperdroid VredditDownloader
YOUREABOT YTubeInfoBot URLfixerBot TweetsInCommentsBot SovietRussiaBot ShibeBot PressFBot
LittleHelperRobot LinkFixerBot LinkFixerBotSnr Link_Demobilizer LazyLinkerBot Darnit_Bot checks_out_bot
HippoBot9000 [deleted] automoderator
""".split()


def _normalised(names: DataFrame) -> DataFrame:
    return names.select(normal_name(F.col("value")).alias("name")).filter(F.col("name") != "").distinct()


def read_ignore_list(spark: SparkSession, path: str) -> DataFrame:
    """One name per line, trimmed and lower-cased, in column ``name``."""
    return _normalised(spark.read.text(path))


def default_ignore_list(spark: SparkSession) -> DataFrame:
    return _normalised(spark.createDataFrame([(n,) for n in DEFAULT_IGNORED_NAMES], "value string"))
