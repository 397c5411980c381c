"""Code tables. Fixed values of public registries are listed plainly; large registries are parameters.

``languages`` is built from the Java runtime's locale registry. The four-character codec table has the common codes;
``codec_table`` takes more rows (code, name), so a full registry can be joined without being kept here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bibliographic ISO 639-2 codes that differ from the terminologic ones.
BIBLIOGRAPHIC = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de",
    "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}
SPECIAL = {"und": "Undetermined", "mul": "Multiple languages", "mis": "Uncoded languages", "zxx": "No linguistic content"}

# WAVE format tags (RFC 2361 and later registrations).
TWOCC = {
    0x0000: "Unknown", 0x0001: "PCM", 0x0002: "Microsoft ADPCM", 0x0003: "IEEE float", 0x0005: "IBM CVSD", 0x0006: "A-law", 0x0007: "mu-law", 0x0008: "DTS", 0x000A: "WMA Voice 9",
    0x0010: "OKI ADPCM", 0x0011: "IMA ADPCM", 0x0014: "G.723 ADPCM", 0x0016: "DIGIFIX", 0x0017: "Dialogic ADPCM", 0x0020: "Yamaha ADPCM", 0x0022: "DSP Group TrueSpeech",
    0x0030: "Dolby AC-2", 0x0031: "GSM 6.10", 0x0040: "G.721 ADPCM", 0x0042: "Microsoft G.723.1", 0x0045: "G.726 ADPCM", 0x0050: "MPEG Layer-2", 0x0055: "MPEG Layer-3",
    0x0061: "Duck DK4 ADPCM", 0x0062: "Duck DK3 ADPCM", 0x0064: "G.726 ADPCM (APICOM)", 0x0075: "Voxware RT29", 0x0092: "Dolby AC-3 SPDIF", 0x00FF: "AAC",
    0x0130: "Sipro Lab ACELP.net", 0x0160: "Windows Media Audio 1", 0x0161: "Windows Media Audio 2", 0x0162: "Windows Media Audio 9 Professional", 0x0163: "Windows Media Audio 9 Lossless",
    0x0270: "Sony ATRAC3", 0x0401: "Intel Music Coder", 0x1600: "MPEG ADTS AAC", 0x2000: "AC-3", 0x2001: "DTS", 0x5756: "WavPack", 0x674F: "Ogg Vorbis 1", 0x6750: "Ogg Vorbis 2",
    0x6751: "Ogg Vorbis 3", 0x676F: "Ogg Vorbis 1+", 0x77A1: "TTA", 0xF1AC: "FLAC", 0xFFFE: "Extensible",
}

# Common four-character codes.
FOURCC = {
    "AVC1": "H.264/AVC", "CVID": "Cinepak", "DIV3": "DivX 3 Low-Motion", "DIV4": "DivX 3 Fast-Motion", "DIVX": "DivX", "DX50": "DivX 5", "DVSD": "DV", "FFV1": "FF Video 1", "FLV1": "Sorenson Spark",
    "H261": "H.261", "H263": "H.263", "H264": "H.264/AVC", "HFYU": "HuffYUV", "HEVC": "H.265/HEVC", "IV32": "Indeo 3.2", "IV50": "Indeo 5.0", "MJPG": "Motion JPEG", "MP41": "MPEG-4 V1", "MP42": "MPEG-4 V2",
    "MP43": "MPEG-4 V3", "MP4A": "MPEG-4 AAC", "MP4S": "Microsoft MPEG-4", "MP4V": "MPEG-4 Video", "MPG1": "MPEG-1 Video", "MPG2": "MPEG-2 Video", "RV10": "RealVideo 1", "RV20": "RealVideo G2", "RV30": "RealVideo 8",
    "RV40": "RealVideo 9", "SNOW": "Snow", "SVQ1": "Sorenson Video 1", "SVQ3": "Sorenson Video 3", "THEO": "Theora", "VP31": "VP3", "VP60": "VP6", "VP80": "VP8", "VP90": "VP9", "WMV1": "Windows Media Video 7",
    "WMV2": "Windows Media Video 8", "WMV3": "Windows Media Video 9", "XVID": "XviD", "YV12": "Planar YUV 4:2:0", "AC-3": "AC-3", "QDM2": "QDesign Music 2", "SAMR": "AMR narrow band", "TWOS": "PCM big-endian", "SOWT": "PCM little-endian",
}

# ID3v1 genres with their first extensions, in numeric order.
GENRES = (
    "Blues|Classic Rock|Country|Dance|Disco|Funk|Grunge|Hip-Hop|Jazz|Metal|New Age|Oldies|Other|Pop|R&B|Rap|Reggae|Rock|Techno|Industrial|Alternative|Ska|Death Metal|Pranks|Soundtrack|Euro-Techno|"
    "Ambient|Trip-Hop|Vocal|Jazz+Funk|Fusion|Trance|Classical|Instrumental|Acid|House|Game|Sound Clip|Gospel|Noise|AlternRock|Bass|Soul|Punk|Space|Meditative|Instrumental Pop|Instrumental Rock|Ethnic|"
    "Gothic|Darkwave|Techno-Industrial|Electronic|Pop-Folk|Eurodance|Dream|Southern Rock|Comedy|Cult|Gangsta|Top 40|Christian Rap|Pop/Funk|Jungle|Native American|Cabaret|New Wave|Psychadelic|Rave|"
    "Showtunes|Trailer|Lo-Fi|Tribal|Acid Punk|Acid Jazz|Polka|Retro|Musical|Rock & Roll|Hard Rock|Folk|Folk-Rock|National Folk|Swing|Fast Fusion|Bebob|Latin|Revival|Celtic|Bluegrass|Avantgarde|"
    "Gothic Rock|Progressive Rock|Psychedelic Rock|Symphonic Rock|Slow Rock|Big Band|Chorus|Easy Listening|Acoustic|Humour|Speech|Chanson|Opera|Chamber Music|Sonata|Symphony|Booty Bass|Primus|Porn Groove|"
    "Satire|Slow Jam|Club|Tango|Samba|Folklore|Ballad|Power Ballad|Rhythmic Soul|Freestyle|Duet|Punk Rock|Drum Solo|A capella|Euro-House|Dance Hall"
).split("|")

# Later genres of version 1 tags, which follow those above.
GENRES_V1 = GENRES + (
    "Goa|Drum & Bass|Club-House|Hardcore|Terror|Indie|BritPop|Negerpunk|Polsk Punk|Beat|Christian Gangsta Rap|Heavy Metal|Black Metal|Crossover|Contemporary Christian|Christian Rock|Merengue|Salsa|Thrash Metal|Anime|JPop|Synthpop"
).split("|")

# QuickTime language codes of the older, numeric kind.
QT_LANGUAGES = dict(enumerate("en fr de it nl sv es da pt no he ja ar fi el is mt tr hr zh ur hi th ko lt pl hu et lv se fo fa ru zh nl ga sq ro cs sk sl yi sr mk bg uk be uz kk az az hy ka mo ky tg tk mn mn ps ku ks sd bo ne sa mr bn as gu pa or ml kn ta te si my km lo vi id tl ms ms am ti om so sw rw rn ny mg eo".split())) | {
    128: "cy", 129: "eu", 130: "ca", 131: "la", 132: "qu", 133: "gn", 134: "ay", 135: "tt", 136: "ug", 137: "dz", 138: "jv",
}

# Matroska codec ids and their codes.
MATROSKA_CODECS = {
    "V_THEORA": "THEO", "V_SNOW": "SNOW", "V_MPEG4/ISO/ASP": "MP4V", "V_MPEG4/ISO/AVC": "AVC1", "A_AC3": "0x2000", "A_MPEG/L3": "0x55", "A_MPEG/L2": "0x50", "A_MPEG/L1": "0x50", "A_DTS": "0x2001",
    "A_PCM/INT/LIT": "0x1", "A_PCM/FLOAT/IEEE": "0x3", "A_TTA1": "0x77a1", "A_WAVPACK4": "0x5756", "A_VORBIS": "0x6750", "A_FLAC": "0xf1ac", "A_AAC": "0xff",
}

# Stereo modes of Matroska video tracks.
STEREO_MODES = {
    1: "side by side (left eye is first)", 2: "top-bottom (right eye is first)", 3: "top-bottom (left eye is first)", 4: "checkboard (right is first)", 5: "checkboard (left is first)",
    6: "row interleaved (right is first)", 7: "row interleaved (left is first)", 8: "column interleaved (right is first)", 9: "column interleaved (left is first)", 10: "anaglyph (cyan/red)",
    11: "side by side (right eye is first)", 12: "anaglyph (green/magenta)", 13: "both eyes laced in one Block (left eye is first)", 14: "both eyes laced in one Block (right eye is first)",
}

# Names of embedded picture types.
PICTURE_TYPES = (
    "Other|32x32 icon|Other icon|Front Cover|Back Cover|Leaflet|Media|Lead artist|Artist|Conductor|Band/Orchestra|Composer|Lyricist/text writer|Recording Location|"
    "Recording|Performance|Screen capture|A bright colored fish|Illustration|Band/artist|Publisher/Studio"
).split("|")

# Names of IPTC datasets of record 2, and the attributes that they become (in order of preference).
IPTC_NAMES = {
    5: "object name", 7: "edit status", 8: "editorial update", 10: "urgency", 12: "subject reference", 15: "category", 20: "supplemental category", 22: "fixture identifier", 25: "keywords", 26: "content location code",
    27: "content location name", 30: "release date", 35: "release time", 37: "expiration date", 38: "expiration time", 40: "special instructions", 42: "action advised", 45: "reference service", 47: "reference date", 50: "reference number",
    55: "date created", 60: "time created", 62: "digital creation date", 63: "digital creation time", 65: "originating program", 70: "program version", 75: "object cycle", 80: "by-line", 85: "by-line title", 90: "city", 92: "sub-location",
    95: "province/state", 100: "country/primary location code", 101: "country/primary location name", 103: "original transmission reference", 105: "headline", 110: "credit", 115: "source", 116: "copyright notice", 118: "contact",
    120: "caption-abstract", 122: "writer-editor", 130: "image type", 131: "image orientation", 135: "language identifier",
} | {200 + k: f"custom{k + 1}" for k in range(20)}
IPTC_ATTRIBUTES = {
    "title": ("by-line title", "headline"), "author": ("writer-editor", "credit", "by-line"), "country": ("country/primary location name",), "description": ("caption-abstract",), "city": ("city",), "location": ("sub-location",),
}

# TIFF and EXIF tags.
EXIF_NAMES = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010A: "FillOrder", 0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model",
    0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts", 0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfiguration", 0x0128: "ResolutionUnit",
    0x012D: "TransferFunction", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x0156: "TransferRange", 0x0200: "JPEGProc", 0x0201: "JPEGInterchangeFormat",
    0x0202: "JPEGInterchangeFormatLength", 0x0211: "YCbCrCoefficients", 0x0212: "YCbCrSubSampling", 0x0213: "YCbCrPositioning", 0x0214: "ReferenceBlackWhite", 0x828D: "CFARepeatPatternDim", 0x828E: "CFAPattern", 0x828F: "BatteryLevel",
    0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x83BB: "IPTC/NAA", 0x8769: "ExifOffset", 0x8773: "InterColorProfile", 0x8822: "ExposureProgram", 0x8824: "SpectralSensitivity", 0x8825: "GPSInfo", 0x8827: "ISOSpeedRatings",
    0x8828: "OECF", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue",
    0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9214: "SubjectArea",
    0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized", 0xA000: "FlashPixVersion", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageLength",
    0xA005: "InteroperabilityOffset", 0xA20B: "FlashEnergy", 0xA20C: "SpatialFrequencyResponse", 0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit", 0xA214: "SubjectLocation",
    0xA215: "ExposureIndex", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA302: "CFAPattern", 0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio",
    0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness", 0xA40C: "SubjectDistanceRange",
}
# Tags of the directory of interoperability.
INTEROP_NAMES = {0x0001: "InteroperabilityIndex", 0x0002: "InteroperabilityVersion", 0x1000: "RelatedImageFileFormat", 0x1001: "RelatedImageWidth", 0x1002: "RelatedImageLength"}
# What the numbers of TIFF and EXIF entries mean, by tag.
EXIF_MEANINGS = {
    0x0103: {1: "Uncompressed TIFF", 6: "JPEG Compressed"},
    0x0128: {1: "Not Absolute", 2: "Pixels/Inch", 3: "Pixels/Centimeter"},
    0x8822: {0: "Unidentified", 1: "Manual", 2: "Program Normal", 3: "Aperture Priority", 4: "Shutter Priority", 5: "Program Creative", 6: "Program Action", 7: "Portrait Mode", 8: "Landscape Mode"},
    0x9101: {0: "", 1: "Y", 2: "Cb", 3: "Cr", 4: "Red", 5: "Green", 6: "Blue"},
    0x9207: {0: "Unidentified", 1: "Average", 2: "CenterWeightedAverage", 3: "Spot", 4: "MultiSpot"},
    0x9208: {0: "Unknown", 1: "Daylight", 2: "Fluorescent", 3: "Tungsten", 10: "Flash", 17: "Standard Light A", 18: "Standard Light B", 19: "Standard Light C", 20: "D55", 21: "D65", 22: "D75", 255: "Other"},
    0x9209: {
        0: "No", 1: "Fired", 5: "Fired (?)", 7: "Fired (!)", 9: "Fill Fired", 13: "Fill Fired (?)", 15: "Fill Fired (!)", 16: "Off", 24: "Auto Off", 25: "Auto Fired", 29: "Auto Fired (?)", 31: "Auto Fired (!)", 32: "Not Available",
    },
    0xA300: {3: "Digital Camera"},
    0xA301: {1: "Directly Photographed"},
    0xA402: {0: "Auto Exposure", 1: "Manual Exposure", 2: "Auto Bracket"},
    0xA403: {0: "Auto", 1: "Manual"},
}
GPS_NAMES = dict(enumerate(
    "GPSVersionID GPSLatitudeRef GPSLatitude GPSLongitudeRef GPSLongitude GPSAltitudeRef GPSAltitude GPSTimeStamp GPSSatellites GPSStatus GPSMeasureMode GPSDOP GPSSpeedRef GPSSpeed GPSTrackRef GPSTrack GPSImgDirectionRef "
    "GPSImgDirection GPSMapDatum GPSDestLatitudeRef GPSDestLatitude GPSDestLongitudeRef GPSDestLongitude GPSDestBearingRef GPSDestBearing GPSDestDistanceRef GPSDestDistance".split()
))
# Common entries of makers' notes.
MAKER_NAMES = {
    "NIKON": {
        0x0001: "MakernoteVersion", 0x0002: "ISOSetting", 0x0003: "ColorMode", 0x0004: "Quality", 0x0005: "Whitebalance", 0x0006: "ImageSharpening", 0x0007: "FocusMode", 0x0008: "FlashSetting", 0x0009: "AutoFlashMode",
        0x000B: "WhiteBalanceBias", 0x000D: "ProgramShift", 0x000E: "ExposureDifference", 0x000F: "ISOSelection", 0x0012: "FlashCompensation", 0x0013: "ISOSpeedRequested", 0x0018: "FlashBracketCompensationApplied",
        0x0080: "ImageAdjustment", 0x0081: "ToneCompensation", 0x0082: "AuxiliaryLens", 0x0083: "LensType", 0x0084: "LensMinMaxFocalMaxAperture", 0x0085: "ManualFocusDistance", 0x0086: "DigitalZoomFactor", 0x0087: "FlashMode",
        0x0089: "BracketingMode", 0x008D: "ColorMode", 0x008F: "SceneMode", 0x0090: "LightingType", 0x0092: "HueAdjustment", 0x0095: "NoiseReduction", 0x00A0: "SerialNumber", 0x00A7: "TotalShutterReleases",
    },
    "OLYMPUS": {0x0200: "SpecialMode", 0x0201: "JPEGQual", 0x0202: "Macro", 0x0204: "DigitalZoom", 0x0207: "SoftwareRelease", 0x0208: "PictureInfo", 0x0209: "CameraID", 0x1004: "FlashMode", 0x1006: "Bracket", 0x100B: "FocusMode", 0x1015: "WhiteBalance"},
    "CASIO": {0x0001: "RecordingMode", 0x0002: "Quality", 0x0003: "FocusingMode", 0x0004: "FlashMode", 0x0005: "FlashIntensity", 0x0006: "Object Distance", 0x0007: "WhiteBalance", 0x000B: "Sharpness", 0x000C: "Contrast", 0x000D: "Saturation", 0x0014: "CCDSpeed"},
    "FUJIFILM": {0x0000: "NoteVersion", 0x1000: "Quality", 0x1001: "Sharpness", 0x1002: "WhiteBalance", 0x1003: "Color", 0x1004: "Tone", 0x1010: "FlashMode", 0x1011: "FlashStrength", 0x1020: "Macro", 0x1021: "FocusMode", 0x1030: "SlowSync", 0x1031: "PictureMode", 0x1300: "BlurWarning", 0x1301: "FocusWarning", 0x1302: "AEWarning"},
    "CANON": {0x0001: "CameraSettings", 0x0004: "ShotInfo", 0x0006: "ImageType", 0x0007: "FirmwareVersion", 0x0008: "ImageNumber", 0x0009: "OwnerName", 0x000C: "SerialNumber"},
}
# What makers keep in arrays of 16-bit numbers: (make, tag), then position: (name, names of values).
MAKER_ARRAYS = {
    ("CANON", 0x0001): {
        1: ("Macromode", {1: "Macro", 2: "Normal"}),
        2: ("SelfTimer", {}),
        3: ("Quality", {2: "Normal", 3: "Fine", 5: "Superfine"}),
        4: ("FlashMode", {0: "Flash Not Fired", 1: "Auto", 2: "On", 3: "Red-Eye Reduction", 4: "Slow Synchro", 5: "Auto + Red-Eye Reduction", 6: "On + Red-Eye Reduction", 16: "external flash"}),
        5: ("ContinuousDriveMode", {0: "Single Or Timer", 1: "Continuous"}),
        7: ("FocusMode", {0: "One-Shot", 1: "AI Servo", 2: "AI Focus", 3: "MF", 4: "Single", 5: "Continuous", 6: "MF"}),
        10: ("ImageSize", {0: "Large", 1: "Medium", 2: "Small"}),
        11: ("EasyShootingMode", {0: "Full Auto", 1: "Manual", 2: "Landscape", 3: "Fast Shutter", 4: "Slow Shutter", 5: "Night", 6: "B&W", 7: "Sepia", 8: "Portrait", 9: "Sports", 10: "Macro/Close-Up", 11: "Pan Focus"}),
        12: ("DigitalZoom", {0: "None", 1: "2x", 2: "4x"}),
        13: ("Contrast", {0xFFFF: "Low", 0: "Normal", 1: "High"}),
        14: ("Saturation", {0xFFFF: "Low", 0: "Normal", 1: "High"}),
        15: ("Sharpness", {0xFFFF: "Low", 0: "Normal", 1: "High"}),
        16: ("ISO", {0: "See ISOSpeedRatings Tag", 15: "Auto", 16: "50", 17: "100", 18: "200", 19: "400"}),
        17: ("MeteringMode", {3: "Evaluative", 4: "Partial", 5: "Center-weighted"}),
        18: ("FocusType", {0: "Manual", 1: "Auto", 3: "Close-Up (Macro)", 8: "Locked (Pan Mode)"}),
        19: ("AFPointSelected", {0x3000: "None (MF)", 0x3001: "Auto-Selected", 0x3002: "Right", 0x3003: "Center", 0x3004: "Left"}),
        20: ("ExposureMode", {0: "Easy Shooting", 1: "Program", 2: "Tv-priority", 3: "Av-priority", 4: "Manual", 5: "A-DEP"}),
        23: ("LongFocalLengthOfLensInFocalUnits", {}),
        24: ("ShortFocalLengthOfLensInFocalUnits", {}),
        25: ("FocalUnitsPerMM", {}),
        28: ("FlashActivity", {0: "Did Not Fire", 1: "Fired"}),
        29: ("FlashDetails", {14: "External E-TTL", 13: "Internal Flash", 11: "FP Sync Used", 7: '2nd("Rear")-Curtain Sync Used', 4: "FP Sync Enabled"}),
        32: ("FocusMode", {0: "Single", 1: "Continuous"}),
    },
    ("CANON", 0x0004): {
        7: ("WhiteBalance", {0: "Auto", 1: "Sunny", 2: "Cloudy", 3: "Tungsten", 4: "Fluorescent", 5: "Flash", 6: "Custom"}),
        9: ("SequenceNumber", {}),
        14: ("AFPointUsed", {}),
        15: ("FlashBias", {
            0xFFC0: "-2 EV", 0xFFCC: "-1.67 EV", 0xFFD0: "-1.50 EV", 0xFFD4: "-1.33 EV", 0xFFE0: "-1 EV", 0xFFEC: "-0.67 EV", 0xFFF0: "-0.50 EV", 0xFFF4: "-0.33 EV", 0x0000: "0 EV",
            0x000C: "0.33 EV", 0x0010: "0.50 EV", 0x0014: "0.67 EV", 0x0020: "1 EV", 0x002C: "1.33 EV", 0x0030: "1.50 EV", 0x0034: "1.67 EV", 0x0040: "2 EV",
        }),
        19: ("SubjectDistance", {}),
    },
}
# The parts of Olympus' special mode.
SPECIAL_MODES = ("Normal", "Unknown", "Fast", "Panorama")
PANORAMA = ("Non-panoramic", "Left to right", "Right to left", "Bottom to top", "Top to bottom")
ORIENTATIONS = ("Horizontal (normal)|Mirrored horizontal|Rotated 180|Mirrored vertical|Mirrored horizontal then rotated 90 CCW|Rotated 90 CW|Mirrored horizontal then rotated 90 CW|Rotated 90 CCW").split("|")

# MPEG frame rates and aspect ratios, MP3 and AC-3 rates.
MPEG_RATES = [None, 24000 / 1001, 24.0, 25.0, 30000 / 1001, 30.0, 50.0, 60000 / 1001, 60.0]
MPEG_ASPECTS = [None, 1.0, 4 / 3, 16 / 9, 2.21]
MP3_BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MP3_RATES = {0: (11025, 12000, 8000), 2: (22050, 24000, 16000), 3: (44100, 48000, 32000)}
MP3_MODES = ("stereo", "joint stereo", "dual channel", "mono")
AC3_RATES = (48000, 44100, 32000)
AC3_BITRATES = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
AC3_CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)


def lookup(table: dict, key: Column) -> Column:
    """A small table as a map literal: no join, no shuffle."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def pick(values, index: Column) -> Column:
    """values[index], null beyond the ends."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.when(index >= 0, index).cast("int"))


def languages(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(code, language): two- and three-letter codes, from the Java runtime's locale registry. ``more`` has rows that go before it."""
    locale = spark.sparkContext._jvm.java.util.Locale
    english, rows = locale.ENGLISH, dict(SPECIAL)
    for two in locale.getISOLanguages():
        one = locale.forLanguageTag(two)
        rows[two] = rows[one.getISO3Language()] = one.getDisplayLanguage(english)
    rows |= {b: rows[two] for b, two in BIBLIOGRAPHIC.items()}
    own = spark.createDataFrame(sorted(rows.items()), "code string, language string")
    return own if more is None else _first(more.select(F.lower("code").alias("code"), "language"), own, "language")


def codec_table(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(code, codec): hexadecimal tags as 0x.. and upper-case four-character codes. ``more`` has rows that go before the built-in ones."""
    rows = [(hex(k), v) for k, v in TWOCC.items()] + list(FOURCC.items())
    own = spark.createDataFrame(rows, "code string, codec string")
    return own if more is None else _first(more.select(codec_key(F.col("code")).alias("code"), "codec"), own, "codec")


def codec_key(code: Column) -> Column:
    """A code as registries' rows are found by: tags as 0x.. without leading zeros, all else in upper case."""
    return F.when(code.rlike("^0[xX][0-9a-fA-F]{1,8}$"), F.concat(F.lit("0x"), F.lower(F.hex(F.conv(F.substring(code, 3, 8), 16, 10).cast("long"))))).otherwise(F.upper(code))


def _first(more: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """One row a code: the smallest of ``more``'s values, else the own one."""
    both = more.select("code", F.lit(0).alias("r__"), value).unionByName(own.select("code", F.lit(1).alias("r__"), value))
    return both.where(F.col("code").isNotNull() & F.col(value).isNotNull()).groupBy("code").agg(F.min(F.struct("r__", value))[value].alias(value))
