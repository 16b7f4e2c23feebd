"""Fixed tables of formats and codec ids, as rows of text with bars between the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Container formats: name|info|url|extensions|commercial name|media type.
CONTAINERS = """
Matroska||https://matroska.org/downloads/windows.html|mkv mk3d mka mks|Matroska|
WebM||http://www.webmproject.org/|webm|WebM|video/webm
MPEG-4|||braw mov mp4 m4v m4a m4b m4p m4r 3ga 3gpa 3gpp 3gp 3gpp2 3g2 k3g jpm jpx mqv ismv isma ismt f4a f4b f4v|MPEG-4|video/mp4
QuickTime|||mov qt|QuickTime|video/quicktime
AVI|Audio Video Interleave||avi|AVI|video/vnd.avi
Wave|||act at9 wav|Wave|audio/vnd.wave
AIFF|Apple/SGI||aiff aifc aif|AIFF|audio/x-aiff
AU|uLaw/AU Audio File||au|AU|audio/basic
CAF|Core Audio Format|https://developer.apple.com/library/content/documentation/MusicAudio/Reference/CAFSpec/CAF_overview/CAF_overview.html|caf|CAF|audio/x-caf
Ogg||https://en.wikipedia.org/wiki/Ogg|oga ogg ogm ogv ogx opus spx|Ogg|video/ogg
Windows Media|||asf dvr-ms wma wmv|Windows Media|video/x-ms-wmv
MPEG-PS|||mpeg mpg m2p vob vro pss evo|MPEG-PS|video/MP2P
MPEG-TS|||ts m2t m2s m4t m4s tmf ts tp trp ty|MPEG-TS|video/MP2T
BDAV|Blu-ray Video||m2ts mts ssif|BDAV|
Flash Video||http://www.macromedia.com/go/getflashplayer|flv|Flash Video|video/x-flv
RealMedia|||rm rmvb ra|RealMedia|application/vnd.rn-realmedia
MXF|||mxf|MXF|application/mxf
Nut||||Nut|
IVF|||ivf|IVF|
DV|||dv dif|DV|video/DV
AVC|Advanced Video Codec|http://developers.videolan.org/x264.html|avc h264 264|AVC|video/H264
HEVC|High Efficiency Video Coding|http://www.itu.int|hevc h265 265|HEVC|video/H265
MPEG Video|||mpgv mpv mp1v m1v mp2v m2v|MPEG Video|video/MPV
MPEG-4 Visual|||m4v mp4v|MPEG-4 Visual|video/MP4V-ES
AV1|AOMedia Video 1|http://aomedia.org/|obu av1|AV1|
VC-3||||VC-3|
JPEG|||h3d jpeg jpg jpe jps mpo|JPEG|image/jpeg
JPEG 2000||http://www.morgan-multimedia.com/JPEG 2000/|jp2|JPEG 2000|image/jp2
PNG|Portable Network Graphic||png pns|PNG|image/png
GIF|Graphics Interchange Format||gif gis|GIF|image/gif
Bitmap|||bmp bms|Bitmap|image/bmp
TIFF|||tiff tif|TIFF|image/tiff
WebP|||webp|WebP|image/webp
MPEG Audio|||m1a mpa mpa1 mp1 m2a mpa2 mp2 mp3|MPEG Audio|audio/mpeg
ADTS|Audio Data Transport Stream||aac aacp adts|ADTS|
LATM||||LATM|
AC-3|Audio Coding 3|https://en.wikipedia.org/wiki/AC3|ac3|Dolby Digital|
E-AC-3|Enhanced AC-3|https://en.wikipedia.org/wiki/Dolby_Digital_Plus|dd+ ec3 eac3|Dolby Digital Plus|audio/eac3
DTS|Digital Theater Systems|https://en.wikipedia.org/wiki/DTS_(sound_system)|dts dtshd|DTS|
MLP|Meridian Lossless Packing|||MLP Lossless|
MLP FBA|Meridian Lossless Packing FBA|||Dolby TrueHD|
FLAC|Free Lossless Audio Codec|https://xiph.org/flac/|fla flac|FLAC|audio/x-flac
WavPack||http://www.wavpack.com|wv wvc|WavPack|
TTA||||TTA|
Monkey's Audio||http://www.monkeysaudio.com|ape mac|Monkey's Audio|
AMR|Adaptive Multi-Rate|http://www.apple.com/quicktime/download/standalone.html|amr|AMR|audio/AMR
SubRip||http://ffdshow.sourceforge.net/tikiwiki/tiki-index.php?page=Getting+ffdshow|srt|SubRip|
ASS|Advanced SubStation Alpha|http://ffdshow.sourceforge.net/tikiwiki/tiki-index.php?page=Getting+ffdshow|ssa|ASS|
SSA|SubStation Alpha|http://ffdshow.sourceforge.net/tikiwiki/tiki-index.php?page=Getting+ffdshow|ssa|SSA|
WebVTT|||vtt|WebVTT|
VobSub|||idx sub|VobSub|
"""
#: Formats of elementary streams, the same columns.
STREAMS = """
AVC|Advanced Video Codec|http://developers.videolan.org/x264.html||AVC|video/H264
HEVC|High Efficiency Video Coding|http://www.itu.int||HEVC|video/H265
MPEG Video||||MPEG Video|video/MPV
MPEG-4 Visual||||MPEG-4 Visual|video/MP4V-ES
AV1|AOMedia Video 1|http://aomedia.org/||AV1|
VP8||http://www.webmproject.org/||VP8|
VP9||||VP9|
Theora||http://www.theora.org/||Theora|
JPEG||||JPEG|video/JPEG
H.263||||H.263|video/H263
Sorenson Spark||||Sorenson Spark|
RealVideo 1||||RealVideo 1|
RealVideo 2||||RealVideo 2|
RealVideo 3||||RealVideo 3|
RealVideo 4||||RealVideo 4|
VC-1||||VC-1|
VC-3||||VC-3|
WMV1||||WMV1|
WMV2||||WMV2|
WMV3||||WMV3|
DV||||DV|video/DV
YUV||||YUV|
RGB||||RGB|
ProRes||||ProRes|
PNG|Portable Network Graphic|||PNG|image/png
GIF|Graphics Interchange Format|||GIF|image/gif
Bitmap||||Bitmap|image/bmp
TIFF||||TIFF|image/tiff
WebP||||WebP|image/webp
JPEG 2000||http://www.morgan-multimedia.com/JPEG 2000/||JPEG 2000|image/jp2
AAC|Advanced Audio Codec|||AAC|
MPEG Audio||||MPEG Audio|audio/mpeg
AC-3|Audio Coding 3|https://en.wikipedia.org/wiki/AC3||Dolby Digital|
E-AC-3|Enhanced AC-3|https://en.wikipedia.org/wiki/Dolby_Digital_Plus||Dolby Digital Plus|audio/eac3
DTS|Digital Theater Systems|https://en.wikipedia.org/wiki/DTS_(sound_system)||DTS|
MLP|Meridian Lossless Packing|||MLP Lossless|
MLP FBA|Meridian Lossless Packing FBA|||Dolby TrueHD|
FLAC|Free Lossless Audio Codec|https://xiph.org/flac/||FLAC|audio/x-flac
Vorbis||http://www.vorbis.com/||Vorbis|audio/vorbis
Opus||http://opus-codec.org/||Opus|audio/opus
Speex||http://www.speex.org/||Speex|audio/speex
PCM||||PCM|
ADPCM||||ADPCM|
ALAC||||ALAC|
WMA||||WMA|
WavPack||http://www.wavpack.com||WavPack|
TTA||||TTA|
Monkey's Audio||http://www.monkeysaudio.com||Monkey's Audio|
AMR|Adaptive Multi-Rate|http://www.apple.com/quicktime/download/standalone.html||AMR|audio/AMR
Cook||||Cook|
UTF-8||||UTF-8|
ASS||http://ffdshow.sourceforge.net/tikiwiki/tiki-index.php?page=Getting+ffdshow||ASS|
SSA||http://ffdshow.sourceforge.net/tikiwiki/tiki-index.php?page=Getting+ffdshow||SSA|
WebVTT||||WebVTT|
VobSub||||VobSub|
PGS||||PGS|
Timed Text||||Timed Text|
RLE|Run-length encoding|||RLE|
SubRip||http://ffdshow.sourceforge.net/tikiwiki/tiki-index.php?page=Getting+ffdshow||SubRip|
Timecode||||Timecode|
"""
#: Formats of images, the same columns.
IMAGES = """
JPEG||||JPEG|image/jpeg
PNG|Portable Network Graphic|||PNG|image/png
GIF|Graphics Interchange Format|||GIF|image/gif
Bitmap||||Bitmap|image/bmp
TIFF||||TIFF|image/tiff
WebP||||WebP|image/webp
JPEG 2000||http://www.morgan-multimedia.com/JPEG 2000/||JPEG 2000|image/jp2
"""
#: Codec ids that say more than their name: id|info|hint|url|description.
CODECS = """
V_MPEG4/ISO/AVC|||http://ffdshow-tryout.sourceforge.net/|
V_MPEG4/ISO/ASP|Advanced Simple Profile||http://www.xvid.org/Downloads.15.0.html|
V_MPEG4/ISO/SP|Simple Profile||http://www.xvid.org/Downloads.15.0.html|
V_MPEG4/ISO/AP|Advanced Profile||http://www.xvid.org/Downloads.15.0.html|
V_MPEG4/MS/V3|Microsoft MPEG-4 v3 (pre-standard)|||
V_MPEG2|MPEG 1 or 2 Video||http://ffdshow-tryout.sourceforge.net/|
V_MPEG1|MPEG 1 or 2 Video||http://ffdshow-tryout.sourceforge.net/|
V_VP8|||http://www.webmproject.org/|
V_VP9|||http://www.webmproject.org/|
V_AV1|||http://aomedia.org/|
V_THEORA|||http://www.theora.org/|
V_REAL/RV40|||http://www.real.com|
V_QUICKTIME|||http://www.apple.com/quicktime/download/standalone.html|
A_FLAC|||https://xiph.org/flac|
A_MPEG/L3||MP3|http://www.iis.fraunhofer.de/amm/index.html|
A_MPEG/L2||MP2||
A_MPEG/L1||MP1||
A_OPUS|||http://opus-codec.org|
A_VORBIS|||http://www.vorbis.com|
A_WAVPACK4|||http://www.wavpack.com|
A_REAL/COOK|||http://www.real.com|
S_TEXT/UTF8|UTF-8 Plain Text|||
S_TEXT/ASCII|ASCII Plain Text|||
S_TEXT/ASS|Advanced Sub Station Alpha|||
S_TEXT/SSA|Sub Station Alpha|||
S_TEXT/USF|Universal Subtitle Format|||
S_TEXT/WEBVTT|Web Video Text Tracks|||
S_VOBSUB|Picture based|||
S_HDMV/PGS|Picture based|||
avc1|Advanced Video Coding|||
avc3|Advanced Video Coding|||
hvc1|High Efficiency Video Coding||http://www.itu.int/|
hev1|High Efficiency Video Coding||http://www.itu.int/|
av01|||http://aomedia.org/|
vp09|||http://www.webmproject.org/|
vp08|||http://www.webmproject.org/|
s263|||http://www.apple.com/quicktime/download/standalone.html|
mjpa|Motion JPEG A||http://www.apple.com/quicktime/download/standalone.html|
jpeg|||http://www.apple.com/quicktime/download/standalone.html|
apch|Apple ProRes 422 High Quality|||
apcn|Apple ProRes 422 Standard Definition|||
apcs|Apple ProRes 422 LT|||
apco|Apple ProRes 422 Proxy|||
ap4h|Apple ProRes 4444|||
alac|Apple Lossless Audio Codec||http://www.apple.com/quicktime/download/standalone.html|
Opus|||http://opus-codec.org|
fLaC|||https://xiph.org/flac|
sowt|||http://www.apple.com/quicktime/download/standalone.html|
twos|||http://www.apple.com/quicktime/download/standalone.html|
in24|||http://www.apple.com/quicktime/download/standalone.html|
in32|||http://www.apple.com/quicktime/download/standalone.html|
fl32|||http://www.apple.com/quicktime/download/standalone.html|
fl64|||http://www.apple.com/quicktime/download/standalone.html|
samr|||http://www.apple.com/quicktime/download/standalone.html|
1|||http://www.microsoft.com/windows/|
55||MP3|http://www.iis.fraunhofer.de/amm/index.html|
50||MP2||
161|Windows Media Audio||http://www.microsoft.com/windows/windowsmedia/format/codecdownload.aspx|Windows Media Audio V8
160|Windows Media Audio||http://www.microsoft.com/windows/windowsmedia/format/codecdownload.aspx|Windows Media Audio V7
162|Windows Media Audio Professional||http://www.microsoft.com/windows/windowsmedia/format/codecdownload.aspx|
163|Windows Media Audio Lossless||http://www.microsoft.com/windows/windowsmedia/format/codecdownload.aspx|
00000001-0000-0010-8000-00AA00389B71|||http://www.microsoft.com/windows/|
00000003-0000-0010-8000-00AA00389B71||IEEE |http://www.microsoft.com/windows/|
FMP4|||http://ffdshow-tryout.sourceforge.net/|
XVID|||http://www.xvid.org/Downloads.15.0.html|
xvid|||http://www.xvid.org/Downloads.15.0.html|
DIVX|||http://www.divx.com/divx/|
DX50|||http://www.divx.com/divx/|
MP43|Microsoft MPEG-4 v3 (pre-standard)|Microsoft||msmpeg4v3
MP42|Microsoft MPEG-4 v2 (pre-standard)|Microsoft||msmpeg4v2
X264|||http://developers.videolan.org/x264.html|
x264|||http://developers.videolan.org/x264.html|
I420|8 bit Y plane followed by 8 bit 2x2 subsampled U and V planes.|||
WMV1|Windows Media Video 7||http://www.microsoft.com/windows/windowsmedia/format/codecdownload.aspx|wmv1
WMV2|Windows Media Video 8||http://www.microsoft.com/windows/windowsmedia/format/codecdownload.aspx|wmv2
WMV3|Windows Media Video 9||http://www.microsoft.com/windows/windowsmedia/format/codecdownload.aspx|wmv3
WVC1|Windows Media Video 9 Advanced Profile||http://www.microsoft.com/windows/windowsmedia/format/codecdownload.aspx|
RV10|Based on H.263, Real Player 5||http://www.real.com|
RV20|Based on H.263, Real Player 6||http://www.real.com|
RV30|Based on H.264, Real Player 8||http://www.real.com|
RV40|Based on H.264, Real Player 9||http://www.real.com|
dnet|Real Player 3||http://www.real.com|
cook|Based on G.722.1, Real Player 6||http://www.real.com|
3gp4|||http://www.3gpp.org/|
3gp5|||http://www.3gpp.org/|
3gp6|||http://www.3gpp.org/|
M4A |||http://www.apple.com/itunes/|
isom|||http://www.apple.com/quicktime/download/standalone.html|
mp41|||http://www.apple.com/quicktime/download/standalone.html|
mp42|||http://www.apple.com/quicktime/download/standalone.html|
qt  |||http://www.apple.com/quicktime/download/standalone.html|
"""
#: Which tables a kind of stream looks into, in this order.
ORDERS = {"General": [CONTAINERS, STREAMS], "Image": [IMAGES, STREAMS, CONTAINERS], "Stream": [STREAMS, CONTAINERS]}


def rows(table: str) -> list[list[str]]:
    return [line.split("|") for line in table.strip("\n").split("\n")]


def format_rows() -> list[tuple[str, ...]]:
    """kind_group, format, info, url, extensions, commercial, mime: of each group the first table that has the format."""
    out: dict[tuple[str, str], tuple[str, ...]] = {}
    for group, order in ORDERS.items():
        for table in order:
            for name, *values in rows(table):
                out.setdefault((group, name), (group, name, *values))
    return list(out.values())


def _table(spark: SparkSession, values: list, names: str) -> DataFrame:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "\\'") + "'" for x in row) + ")" for row in values)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t({names})")


def format_table(spark: SparkSession) -> DataFrame:
    """A fixed number of rows, so it may be broadcast."""
    return _table(spark, format_rows(), "kind_group, format, info, url, extensions, commercial, mime")


def codec_table(spark: SparkSession) -> DataFrame:
    """A fixed number of rows, so it may be broadcast."""
    return _table(spark, rows(CODECS), "codec, info, hint, url, description")
